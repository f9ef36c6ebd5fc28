from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from symweave.llm import parsing

M = (1 << 64) - 1


def mix(x):
    x = ((x ^ (x >> 32)) * 0xD6E8FEB86659FD93) & M
    x = ((x ^ (x >> 29)) * 0xC2B2AE3D27D4EB4F) & M
    return x ^ (x >> 32)


def tossed(xs):
    """One round of coin tossing."""
    out = []
    for i, x in enumerate(xs):
        before = xs[i - 1] if i else x ^ 1
        k = next(k for k in range(64) if (x ^ before) >> k & 1)
        out.append(2 * k + (x >> k & 1))
    return out


def phrases(xs, level):
    runs = []
    for x in xs:
        if runs and runs[-1][0] == x:
            runs[-1][1] += 1
        else:
            runs.append([x, 1])
    symbols = [x for x, _ in runs] if level > 1 else [mix((x + 1) * 0x9E3779B97F4A7C15 & M) for x, _ in runs]
    xs = [x if n == 1 else mix((x * 0xC2B2AE3D27D4EB4F + n) & M) for x, (_, n) in zip(symbols, runs)]
    lab = xs if level > 1 else [x for x, _ in runs]
    for _ in range(4 if level > 1 else 3):
        lab = tossed(lab)
    assert all(a != b for a, b in zip(lab, lab[1:])) and max(lab) < 6
    for v in (5, 4, 3):
        lab = [min({0, 1, 2} - set(lab[max(0, i - 1) : i + 2])) if x == v else x for i, x in enumerate(lab)]
    assert all(a != b for a, b in zip(lab, lab[1:])) and max(lab) < 3
    cut = [0] + [i for i in range(1, len(xs) - 1) if lab[i - 1] < lab[i] > lab[i + 1]] + [len(xs)]
    out = []
    for a, b in zip(cut, cut[1:]):
        h = level * 0x9E3779B97F4A7C15 & M
        for x in xs[a:b]:
            h = mix((h ^ x) * 0x9E3779B97F4A7C15 & M)
        out.append(h)
    return out


def plain(text):
    """The fingerprint of one text, symbol by symbol."""
    xs = list(text.encode())
    if not xs:
        return parsing.EMPTY
    levels = []
    while not levels or len(xs) > 1:
        xs = phrases(xs, len(levels) + 1)
        levels.append(xs)
    own = max([i for i, p in enumerate(levels[: parsing.TOP], 1) if len(p) >= parsing.LEAST], default=1)
    sketch = lambda names: "".join(f"{mix(min(x * int(t) & M for x in names)) >> 48:04x}" for t in parsing.TIMES)
    return ".".join([f"{xs[0]:016x}", str(own), *[sketch(levels[i - 1]) for i in (own, own - 1) if i]])


def prose(seed, words):
    r = random.Random(seed)
    return " ".join("".join(r.choice("etaoinshr") for _ in range(r.randint(1, 9))) for _ in range(words))


def test_fingerprints_equal_the_plain_parse():
    r = random.Random(1)
    texts = ["", "a", "ab", "aa", "aab", "a" * 5000, "ab" * 999, "Ünïcode ☃ 𝄞", "\0\0\1", prose(3, 3000)]
    texts += [prose(i, r.randint(1, 90)) for i in range(40)] + ["".join(r.choice("ab") for _ in range(r.randint(1, 60))) for _ in range(40)]
    got = parsing.fingerprints([t.encode() for t in texts])
    assert got == [plain(t) for t in texts]
    assert got == parsing._parsed([t.encode() for t in texts]) and len(set(got)) == len(set(texts))


def test_equal_substrings_share_names_at_any_offset():
    common = prose(5, 400)
    for level, least in ((1, 0.98), (2, 0.95), (3, 0.85)):
        names = []
        for before in ("", "x", prose(7, 31)):
            x = np.frombuffer((before + common).encode(), np.uint8)
            first = np.array([0])
            for lv in range(1, level + 1):
                x, first = parsing.next_level(x, first, lv)
            names.append(set(x.tolist()))
        assert len(names[0] & names[1] & names[2]) >= least * len(names[0])


def test_likeness():
    text, other = prose(11, 700), prose(12, 900)
    a, b, c, short = parsing.fingerprints([t.encode() for t in (text, parsing.edited(text, other), other, text[:40])])
    assert parsing.likeness(a, a) == 1 and parsing.likeness(a, parsing.EMPTY) == parsing.likeness(parsing.EMPTY, a) == 0
    assert parsing.likeness(parsing.EMPTY, parsing.EMPTY) == 1
    assert 0.5 < parsing.likeness(a, b) == parsing.likeness(b, a) < 0.9 and parsing.likeness(a, c) < 0.1
    assert parsing.likeness(a, short) == 0


DDL = "doc_id long, text string, bucket string, tail int, h string, T string, fingerprint string"


def expected(rows):
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out = []
    for (i, t), (_, n) in zip(ordered, ordered[1:] + ordered[:1]):
        t, n = t or "", n or ""
        q = len(t) // 4
        new = t[: len(t) - q] + n[:q]
        f, g, h = plain(t), plain(new), plain(n)
        out.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), f, g, round(parsing.likeness(f, g), 9), round(parsing.likeness(f, h), 9)))
    return out


@pytest.mark.parametrize("bucket", [1 << 24, 700])
@pytest.mark.parametrize(
    "rows",
    [
        [],
        [(4, None)],
        [(4, "one text alone")],
        [(2, "b" * 9), (1, None), (3, ""), (None, "no id"), (7, "é☃𝄞" * 40)],
        [(i * 37 % 101, prose(i, 5 + i % 60)) for i in range(101)],
        [(5, "same text"), (5, "same text"), (6, "same text"), (5, "same text"), (9, prose(1, 80))],
        [(1, "short"), (2, prose(2, 20_000)), (3, "")],
    ],
)
def test_edited_texts(spark, monkeypatch, rows, bucket):
    monkeypatch.setattr(parsing, "BUCKET_BYTES", bucket)
    table = spark.createDataFrame([(*r, "x", 1, "y", "z", "w") for r in rows], DDL).repartition(3)
    got = [(r[0], r[1], r[2], r[3], r[4], round(r[5], 9), round(r[6], 9)) for r in parsing.near_texts(table).collect()]
    assert sorted(got, key=repr) == sorted(expected(rows), key=repr)


def test_ties_of_an_id_follow_one_order(spark, monkeypatch):
    rows = [(7 if i % 3 else i, prose(i % 11, 30)) for i in range(60)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    first = sorted(map(tuple, parsing.near_texts(table).collect()))
    monkeypatch.setattr(parsing, "BUCKET_BYTES", 900)
    assert sorted(map(tuple, parsing.near_texts(table.repartition(5)).collect())) == first and len(first) == 60
