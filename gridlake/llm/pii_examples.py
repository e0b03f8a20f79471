"""Labelled examples for the personal-data trees, made by rule from a seed: a bounded table, the same on every run.

They show what a corpus without labels can't: addresses with (at) and (dot), phones without a plus and named
secrets, and beside them what only looks alike: times and handles, dates, versions, codes, sums and ranges,
paths, identifiers, hashes and UUIDs.
"""

from __future__ import annotations

import random
from collections.abc import Callable

#: Examples of each group and label.
EACH = 500

WORDS = "the of and to report meeting value total le des une pour der die und nicht los una que para data file item line code page".split()
HEX = "0123456789abcdef"
MIXED = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"


def _word(r: random.Random, least: int = 3, most: int = 9) -> str:
    return "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(least, most)))


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choices("0123456789", k=n))


def _camel(r: random.Random) -> str:
    return "".join(_word(r).title() for _ in range(r.randint(3, 6)))


def _uuid(r: random.Random) -> str:
    return "-".join("".join(r.choices(HEX, k=n)) for n in (8, 4, 4, 4, 12))


def _obfuscated(r: random.Random) -> str:
    at = r.choice([" (at) ", "(at)", " [at] ", "[at]"])
    dot = r.choice([" (dot) ", "(dot)", " [dot] ", "."])
    name = _word(r) + r.choice(["", "." + _word(r), str(r.randrange(99)), "_" + _word(r)])
    return f"{name}{at}{_word(r)}{dot}{r.choice(['com', 'org', 'net', 'uz', 'de', 'fr', 'co'])}"


def _no_address(r: random.Random) -> str:
    return r.choice([f"{_word(r)} (at) {_word(r)}", f"{_word(r)}@{_word(r)}", f"{_word(r)}[at]{r.randrange(24)}", f"@{_word(r)}".join(["x", ""])])


def _phone(r: random.Random) -> str:
    a, b, c, d = (_digits(r, n) for n in (3, 3, 4, 2))
    return r.choice([f"({a}) {b}-{c}", f"({a}) {b}-{d}-{c[:2]}", f"{a}-{b}-{c}", f"0{a} {b} {c}", f"0{d} {a} {d} {c[:2]}", f"({a}){b}-{c}", f"{d} {b} {d} {c[:2]} {c[2:]}"])


def _no_phone(r: random.Random) -> str:
    day, month, year = r.randint(1, 28), r.randint(1, 12), r.randint(1950, 2030)
    return r.choice(
        [
            f"{year}-{month:02}-{day:02}", f"{year}-{month:02}-{day:02} {r.randrange(24):02}", f"{day:02}.{month:02}.{year} {r.randrange(24):02}", f"{day:02}.{month:02}.{year}", f"{year}-{year + 9}", f"{day:02}-{month:02}-{year}", f"{year}{month:02}{day:02}{_digits(r, 3)}",
            _digits(r, r.randint(7, 12)), f"{r.randint(1, 9)}.{_digits(r, r.randint(7, 12))}", f"978-{r.randint(0, 9)}-{_digits(r, 2)}-{_digits(r, 6)}-{r.randint(0, 9)}",
            " ".join(_digits(r, r.randint(1, 2)) for _ in range(r.randint(6, 9))), f"{r.randint(1, 9)} {_digits(r, 3)} {_digits(r, 3)}.{_digits(r, 2)}", ".".join(str(r.randrange(30)) for _ in range(r.randint(5, 8))),
            f"{_digits(r, 4)}-{_digits(r, 4)}-{_digits(r, 4)}", f"{_digits(r, 2)}.{_digits(r, 4)} {_digits(r, 2)}.{_digits(r, 4)}", _digits(r, r.randint(13, 19)),
        ]
    )


def _secret(r: random.Random) -> str:
    return r.choice([lambda: "".join(r.choices(HEX, k=r.choice([32, 40, 64]))), lambda: "".join(r.choices(MIXED, k=r.randint(20, 48))), lambda: r.choice(["sk-", "ghp_", "AKIA"]) + "".join(r.choices(MIXED, k=r.randint(16, 36)))])()


def _name(r: random.Random) -> str:
    name = r.choice(["token", "secret", "password", "pwd", "api_key", "api key", "access key", "Bearer", "credential", "API_KEY", "auth"])
    return name + r.choice([" = ", "=", ": ", ' = "', '="', ": '", " "])


def _no_secret(r: random.Random) -> str:
    return r.choice(
        [
            lambda: "/".join(_word(r) for _ in range(r.randint(4, 7))), lambda: f"//{_word(r)}/{_word(r)}/{_word(r)}-{_word(r)}-{_word(r)}/index", lambda: _camel(r) + r.choice(["", str(r.randrange(999))]),
            lambda: "_".join(_word(r) for _ in range(r.randint(3, 6))), lambda: "-".join(_word(r) for _ in range(r.randint(3, 6))), lambda: "".join(r.choices(HEX, k=r.choice([32, 40, 64]))), lambda: _uuid(r),
            lambda: f"{_word(r)}_{r.randint(2000, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}_{_word(r)}", lambda: "-" * r.randint(16, 60), lambda: _word(r, 16, 40), lambda: "".join(r.choices(MIXED, k=r.randint(20, 48))),
        ]
    )()


def _before(r: random.Random, group: str, label: int) -> str:
    if group == "secret" and label:
        return _name(r)
    plain = {"email": ["write to ", "mail: ", "contact ", "see ", "ask "], "number": ["on ", "of ", "no. ", "order ", "since ", "call ", "tel ", "phone: ", "at "], "secret": ["commit ", "sha256:", "id ", "see https:", "class ", "file ", "uuid: ", "in ", "merge "]}[group]
    if group == "number" and not label:
        plain = [p for p in plain if p not in ("call ", "tel ", "phone: ")]
    return r.choice(["", r.choice(plain), r.choice(plain)])


MAKERS: dict[tuple[str, int], Callable[[random.Random], str]] = {
    ("email", 1): _obfuscated, ("email", 0): _no_address, ("number", 1): _phone, ("number", 0): _no_phone, ("secret", 1): _secret, ("secret", 0): _no_secret,
}


def examples(each: int = EACH, seed: int = 0) -> list[tuple[str, str, int, int, int]]:
    """(text, group, start, end, label): `each` of every group and label, in code points."""
    r = random.Random(seed)
    out = []
    for (group, label), make in MAKERS.items():
        for _ in range(each):
            head = " ".join(r.choices(WORDS, k=r.randint(0, 4)))
            head = (head + " " if head else "") + _before(r, group, label)
            span = make(r)
            tail = f":{r.randrange(60):02}" if span[-3:-2] == " " and group == "number" and not label else ""
            tail += r.choice([" ", ". ", ", ", '" ', "\n"]) + " ".join(r.choices(WORDS, k=r.randint(0, 4)))
            out.append((head + span + tail, group, len(head), len(head) + len(span), label))
    return out
