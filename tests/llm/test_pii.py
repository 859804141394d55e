"""Pseudonyms against a plain Feistel network, written out in Python, and its inverse."""

from __future__ import annotations

import datetime
import hashlib
import random
import re

from lineament.llm import pii

KEY = "some key"


def mix(kind, r, half, x):
    return int(hashlib.sha256(f"{KEY}/{kind}/{r}/{half}/{x}".encode()).hexdigest()[:13], 16)


def two(kind, a, b, size_a, size_b):
    for r in range(1, pii.ROUNDS + 1):
        if r % 2:
            a = (a + mix(kind, r, "a", b)) % size_a
        else:
            b = (b + mix(kind, r, "b", a)) % size_b
    return a, b


def undone(kind, a, b, size_a, size_b):
    for r in range(pii.ROUNDS, 0, -1):
        if r % 2:
            a = (a - mix(kind, r, "a", b)) % size_a
        else:
            b = (b - mix(kind, r, "b", a)) % size_b
    return a, b


ALPHABETS = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"] + [
    "".join(chr(c) for c in range(a, b) if c not in (215, 247)) for a, b in ((224, 255), (192, 223), (256, 384), (1024, 1152))
]


def moved(s, base, sign):
    stream = "".join(hashlib.sha256(f"{base}/{n}".encode()).hexdigest() for n in range(len(s) // pii.STREAM + 1))
    out = ""
    for i, c in enumerate(s):
        letters = next((x for x in ALPHABETS if c in x), None)
        out += letters[(letters.index(c) + sign * int(stream[4 * i : 4 * i + 4], 16)) % len(letters)] if letters else c
    return out


def text(kind, s, sign=1):
    a, b = s[: len(s) // 2], s[len(s) // 2 :]
    rounds = range(1, pii.ROUNDS + 1)
    for r in rounds if sign > 0 else reversed(rounds):
        base = f"{KEY}/{kind}/{r}/{'a' if r % 2 else 'b'}/{len(a) + len(b)}/{b if r % 2 else a}"
        if r % 2:
            a = moved(a, base, sign)
        else:
            b = moved(b, base, sign)
    return a + b


def luhn(payload):
    total = sum(sum(divmod(2 * int(c), 10)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(payload)))
    return payload + str(-total % 10)


def rest(s):
    return int("".join(str(int(c, 36)) for c in s)) % 97


def account(country, bban):
    return country + f"{98 - rest(bban + country + '00'):02d}" + bban


def values():
    """(kind, value, the pseudonym that the plain version gives)."""
    r = random.Random(3)
    out = []
    for _ in range(60):
        payload = "".join(r.choice("0123456789") for _ in range(r.randint(12, 18)))
        out.append(("number", luhn(payload), luhn(text("number", payload))))
        day = datetime.date(1800, 1, 1) + datetime.timedelta(r.randrange(146097))
        a, b = two("date", *divmod((day - datetime.date(1800, 1, 1)).days, 5411), 27, 5411)
        new = datetime.date(1800, 1, 1) + datetime.timedelta(a * 5411 + b)
        layout = r.choice(["%Y-%m-%d", "%Y/%m/%d", "%d.%m.%Y"])
        out.append(("date", day.strftime(layout), new.strftime(layout)))
        area, group, serial = r.choice([x for x in range(1, 900) if x != 666]), r.randint(1, 99), r.randint(1, 9999)
        a, b = two("national", (area - 1 - (area > 666)) * 99 + group - 1, serial - 1, 898 * 99, 9999)
        out.append(("national", f"{area:03d}-{group:02d}-{serial:04d}", f"{a // 99 + 1 + (a // 99 >= 665):03d}-{a % 99 + 1:02d}-{b + 1:04d}"))
        octets = [r.randrange(256) for _ in range(4)]
        a, b = two("ip", octets[0] * 256 + octets[1], octets[2] * 256 + octets[3], 65536, 65536)
        out.append(("ip", ".".join(map(str, octets)), f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"))
        local = "".join(r.choice("abzXY019._éÀžжñ") for _ in range(r.randint(1, 45)))
        out.append(("email", f"{local}@mail.example.com", text("email", local) + "@mail.example.com"))
        bban = "".join(r.choice("0123456789ABZ") for _ in range(r.choice([14, 18, 20, 26])))
        old, new = account("DE", bban), account("DE", text("iban", bban))
        if r.random() < 0.5:
            old, new = (" ".join(x[i : i + 4] for i in range(0, len(x), 4)) for x in (old, new))
        out.append(("iban", old, new))
    return out


def test_pseudonyms_equal_the_plain_version(spark):
    rows = values()
    frame = spark.createDataFrame([(i, f"see {v} there") for i, (_, v, _) in enumerate(rows)], "id long, text string")
    got = {r.id: r for r in pii.pseudonymised(frame, ["id"], KEY).collect()}
    for i, (kind, v, want) in enumerate(rows):
        assert got[i].text == f"see {want} there" and got[i][f"n_{kind}"] == 1, (kind, v)


def test_the_plain_version_has_an_inverse():
    r = random.Random(4)
    for _ in range(200):
        a, b = r.randrange(898 * 99), r.randrange(9999)
        assert undone("national", *two("national", a, b, 898 * 99, 9999), 898 * 99, 9999) == (a, b)
        s = "".join(r.choice("abzXY019._éÀžж") for _ in range(r.randint(0, 40)))
        assert text("email", text("email", s), -1) == s


def test_only_valid_values_in_whole_local_parts(spark):
    texts = ["DE00 1234 1234 1234 1234 12", "on 31.02.2024 and 2024/13/01", "x@y", "1.2.3.4.5", None, "", "é.müller@x.org"]
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r.id: r.text for r in pii.pseudonymised(frame, ["id"], KEY).collect()}
    assert [got[i] for i in range(6)] == texts[:6]
    local = got[6].split("@")[0]
    assert not set("éü") & set(local) and re.fullmatch(r"\w\.\w{6}", local)


def test_values_are_linked_over_layouts_and_documents(spark):
    frame = spark.createDataFrame([(1, "2024-02-29"), (2, "29.02.2024"), (3, "2024/02/29")] * 2, "id long, text string")
    days = {tuple(sorted(re.findall("[0-9]+", r.text))) for r in pii.pseudonymised(frame, ["id"], KEY).collect()}
    assert len(days) == 1 and days != {("02", "2024", "29")}
