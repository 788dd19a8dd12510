"""The one-pass Spark parser against a per-line brute force with Python ``re``
over the same fixed patterns (search per pattern in priority order), on
randomly assembled lines: envelopes good and bad, messages mixing several
patterns (priority conflicts), odd users, IPv6, Unicode spacing."""
import random
import re

from authsift.functions import patterns as P
from authsift.operators.parse import parse_events
from authsift.sources.auth_log import read_auth_log

ORDER = [("failed", P.FAILED), ("accepted", P.ACCEPTED), ("max_auth", P.MAX_AUTH),
         ("closed_user", P.CLOSED_USER), ("preauth", P.PREAUTH), ("probe", P.PROBE)]


def brute(line):
    line = line.strip()
    env = re.match(P.SSHD_LINE, line)
    if not env:
        return None
    ts, host, msg = env.groups()
    for kind, pat in ORDER:
        m = re.search(pat, msg)
        if not m:
            continue
        g = m.groups()
        if kind == "failed":
            return (ts, host, "failed", g[2], g[3], bool(g[1]), g[0])
        if kind == "accepted":
            return (ts, host, "accepted", g[1], g[2], False, g[0])
        if kind == "max_auth":
            return (ts, host, "max_auth", g[1], g[2], bool(g[0]), None)
        if kind == "closed_user":
            return (ts, host, "preauth_disconnect", g[0], g[1], False, None)
        if kind == "preauth":
            return (ts, host, "preauth_disconnect", "", g[0], False, None)
        return (ts, host, "probe", "", g[0] or g[1], False, None)
    return None


USERS = ["root", "admin", "j.smith", "svc-backup", "José", "a$b", "x y"]
IPS = ["203.0.113.45", "10.0.0.5", "::1", "fe80::1%eth0", "host.example", "1.2.3.4"]
MSGS = [
    "Failed password for {u} from {ip} port {p} ssh2",
    "Failed publickey for invalid user {u} from {ip} port {p} ssh2",
    "Accepted password for {u} from {ip} port {p} ssh2",
    "Accepted publickey for {u} from {ip} port {p} ssh2: RSA SHA256:abc",
    "error: maximum authentication attempts exceeded for {u} from {ip} port {p} ssh2 [preauth]",
    "error: maximum authentication attempts exceeded for invalid user {u} from {ip} port {p} ssh2 [preauth]",
    "Connection closed by authenticating user {u} {ip} port {p} [preauth]",
    "Disconnected from invalid user {u} {ip} port {p} [preauth]",
    "Received disconnect from {ip} port {p}:11: Bye Bye [preauth]",
    "Connection reset by {ip} port {p} [preauth]",
    "Did not receive identification string from {ip} port {p}",
    "banner exchange: Connection from {ip} port {p}: invalid format",
    "Invalid user {u} from {ip} port {p}",
    "pam_unix(sshd:session): session opened for user {u} by (uid=0)",
    "Failed keyboard-interactive/pam for {u} from {ip} port {p} ssh2",
    "Failed password for {u} from {ip} port",
]
ENVELOPES = [
    "Jun  9 03:01:42 web-01 sshd[10012]: ",
    "Jan 19 23:59:59 host-3 sshd[1]:   ",
    "Dec  1 00:00:00 h sshd[2]: ",
    "Jun 9 03:01:42 web-01 sshd[x]: ",          # bad pid: not an sshd line
    "Jun  9 03:01 web-01 sshd[5]: ",             # short clock
    "Jun  9 03:01:42 web-01 cron[5]: ",          # other daemon
    "  Jun  9 03:01:42 web-01 sshd[7]: ",        # leading blanks are stripped
    "Jun\u00a0 9 03:01:42\u2003web-01 sshd[8]:\u00a0",  # Unicode spaces (Python \\s)
    "Jun \u0669 03:01:42 web-01 sshd[9]: ",     # Arabic-Indic digit (Python \\d)
]


def _lines(n, seed):
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        parts = [rnd.choice(MSGS).format(u=rnd.choice(USERS), ip=rnd.choice(IPS),
                                         p=rnd.randint(1, 65535))
                 for _ in range(rnd.choice([1, 1, 2, 3]))]
        out.append(rnd.choice(ENVELOPES) + " then ".join(parts) + rnd.choice(["", " ", "\t"]))
    return out


def test_parser_matches_brute_force(spark, tmp):
    lines = _lines(600, 11)
    path = f"{tmp}/rand.log"
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")
    got = [(r["ts_text"], r["host"], r["action"], r["user"], r["src_ip"], r["invalid_user"],
            r["method"]) for r in parse_events(read_auth_log(spark, path, "r"))
           .orderBy("seq").collect()]
    expected = [b for b in (brute(x) for x in lines) if b is not None]
    assert len(expected) > 200
    assert got == expected
