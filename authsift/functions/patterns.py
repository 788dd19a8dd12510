"""Regular expressions of the sshd log grammar.

FIXED VALUES: these patterns must equal the reference's grammar for results to
match.  They are applied as an unanchored *search* inside the message, except
the line envelope, which is anchored at both ends.  Numbered groups are listed
next to each pattern.  Java's ``\\w \\d \\s`` are ASCII-only by default while
Python's are Unicode, so every pattern is used with the ``(?U)`` flag
(see :func:`java`).
"""

# --- fixed values: sshd line grammar -------------------------------------
# envelope: 1 = syslog time text, 2 = host, 3 = message
SSHD_LINE = r"^(\w{3}\s+\d+\s[\d:]{8})\s+(\S+)\s+sshd\[\d+\]:\s+(.*)$"
# failed: 1 = method, 2 = "invalid user " or empty, 3 = user, 4 = ip, 5 = port
FAILED = r"Failed (password|publickey) for (invalid user )?(\S+) from (\S+) port (\d+)"
# accepted: 1 = method, 2 = user, 3 = ip, 4 = port
ACCEPTED = r"Accepted (password|publickey) for (\S+) from (\S+) port (\d+)"
# max_auth: 1 = "invalid user " or empty, 2 = user, 3 = ip
MAX_AUTH = r"maximum authentication attempts exceeded for (invalid user )?(\S+) from (\S+)"
# preauth_disconnect with a user: 1 = user, 2 = ip
CLOSED_USER = (r"(?:Connection closed by|Disconnected from) (?:authenticating|invalid) user "
               r"(\S+) (\S+) port \d+ \[preauth\]")
# preauth_disconnect without a user: 1 = ip
PREAUTH = r"(?:Received disconnect from|Connection reset by) (\S+) port \d+.*\[preauth\]"
# probe: 1 = ip (no identification string), 2 = ip (invalid banner format)
PROBE = (r"Did not receive identification string from (\S+)"
         r"|Connection from (\S+) port \d+: invalid format")
# Windows sub-status codes meaning "no such user" (exact spellings only)
NO_SUCH_USER = ("0xc0000064", "0xC0000064")
# --------------------------------------------------------------------------


def any_event_line() -> str:
    """One anchored pattern true exactly for sshd lines whose message matches one
    of the six message patterns: the envelope up to the message, then a search
    for any of them (they all start with a letter, so a match lies inside the
    message).  Built from the fixed patterns above."""
    prefix = SSHD_LINE[: -len("(.*)$")]
    alts = "|".join(f"(?:{p})" for p in (FAILED, ACCEPTED, MAX_AUTH, CLOSED_USER, PREAUTH, PROBE))
    return f"{prefix}.*?(?:{alts})"


def group_count(pattern: str) -> int:
    """Number of capturing groups in one of the patterns above."""
    n, i = 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 2
            continue
        if c == "(" and not pattern.startswith("(?", i):
            n += 1
        i += 1
    return n


MESSAGE_KINDS = [("failed", FAILED), ("accepted", ACCEPTED), ("max_auth", MAX_AUTH),
                 ("closed_user", CLOSED_USER), ("preauth", PREAUTH), ("probe", PROBE)]


def dispatch_line() -> tuple[str, dict[str, int]]:
    """The envelope followed by the message patterns as one priority alternation,
    matching the whole line: ``^ENVELOPE(?:.*?(P1)|.*?(P2)|...).*$``.

    An alternation tries every start position of one pattern before the next
    pattern, so the first alternative that matches anywhere in the message wins,
    exactly as a search per pattern in priority order.  Returns the pattern and
    the group number where each kind's own groups start (its whole-match group
    is that number minus one); groups 1 and 2 are the time text and the host.
    """
    prefix = SSHD_LINE[: -len("(.*)$")]
    alts, starts, g = [], {}, group_count(prefix)
    for kind, pat in MESSAGE_KINDS:
        starts[kind] = g + 2
        alts.append(f".*?({pat})")
        g += 1 + group_count(pat)
    return f"{prefix}(?:{'|'.join(alts)}).*$", starts


def java(pattern: str) -> str:
    """Java flavour of a pattern above: Unicode classes and '.' over any char
    but newline, as in Python (lines never contain a newline here)."""
    return "(?Us)" + pattern
