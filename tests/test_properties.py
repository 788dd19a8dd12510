"""Properties: order-free counts, every parsed line has one action, AGG11 edges."""
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from authsift.operators.correlate import correlate
from authsift.operators.parse import ACTIONS, parse_events
from authsift.sources.auth_log import read_auth_log
from conftest import fixture

COUNTS = ["failed_logins", "successful_logins", "invalid_user_attempts",
          "max_auth_exceeded_events", "preauth_disconnects", "connection_probes_no_auth"]


def test_line_shuffle_keeps_counts(spark, tmp):
    with open(fixture("sample_auth.log")) as f:
        lines = f.read().splitlines()
    random.Random(7).shuffle(lines)
    with open(f"{tmp}/shuffled.log", "w") as f:
        f.write("\n".join(lines) + "\n")

    def counts(path):
        a = correlate(parse_events(read_auth_log(spark, path, "x")))
        return sorted(tuple(r) for r in a.select("src_ip", *COUNTS).collect())
    assert counts(f"{tmp}/shuffled.log") == counts(fixture("sample_auth.log"))


def test_each_event_has_one_known_action(spark):
    ev = parse_events(read_auth_log(spark, fixture("sample_auth.log"), "x"))
    assert ev.where(~ev.action.isin(ACTIONS)).count() == 0


_MSG = {
    "f": "Failed password for u from 5.5.5.5 port 22 ssh2",
    "a": "Accepted password for u from 5.5.5.5 port 22 ssh2",
    "p": "Did not receive identification string from 5.5.5.5 port 22",
}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.sampled_from("fap"), min_size=1, max_size=8))
def test_success_after_failures_matches_sequential_scan(spark, kinds):
    import tempfile
    d = tempfile.mkdtemp(prefix="authsift-prop-")
    with open(f"{d}/a.log", "w") as f:
        for i, k in enumerate(kinds):
            f.write(f"Jun  9 10:00:{i:02d} web-01 sshd[1]: {_MSG[k]}\n")
    saw_fail, expected = False, False
    for k in kinds:  # the reference's sequential definition
        if k == "f":
            saw_fail = True
        elif k == "a" and saw_fail:
            expected = True
    r = correlate(parse_events(read_auth_log(spark, f"{d}/a.log", "x"))).collect()[0]
    assert r["success_after_failures"] is expected
