"""Spelling variants (operator 11): the scan of a sorted list, the way to the blocks, and whole results against plain versions and SQL."""

import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from fieldhouse.llm import spelling
from fieldhouse.llm.common import Scratch

DOCS = "doc_id long, text string, word string, n string, form string, root string"


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else (a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :])


def plain(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    vocab = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    near = {w: [v for v in vocab if one_edit(w, v)] for w in vocab}
    form = {}
    for w, n in vocab.items():
        best = min(near[w], key=lambda v: (-vocab[v], v), default=None)
        form[w] = best if best is not None and vocab[best] >= 2 * n else None
    out = set()
    for w, n in vocab.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, n, len(near[w]), form[w], vocab.get(form[w]), root))
    return out


def made(seed, letters, n, shortest=5, longest=9):
    """Words with many near words, and texts that hold them often or rarely."""
    r = random.Random(seed)
    words = {"".join(r.choices(letters, k=r.randint(shortest, longest))) for _ in range(n)}
    for w in list(words):
        i = r.randrange(len(w))
        words |= {w[:i] + w[i + 1 :], w[:i] + r.choice(letters) + w[i:], w[:i] + r.choice(letters) + w[i + 1 :]}
    return sorted(w for w in words if len(w) >= shortest)


@pytest.mark.parametrize(("seed", "letters"), [(1, "ab"), (2, "abc"), (3, "abcdefgÀÿ"), (4, "aaaaab")])
def test_scan_finds_all_words_one_edit_away_that_begin_alike(seed, letters):
    words = made(seed, letters, 250)
    for size in range(5, 11):
        of = [w for w in words if len(w) == size]
        if not of:
            continue
        keys = spelling.letters_of(of)
        for length in (size - 1, size, size + 1):
            asking = [w for w in words if len(w) == length]
            if length < 5 or not asking:
                continue
            q, w = spelling.near_pairs(keys, spelling.shared_letters(keys), spelling.letters_of(asking))
            got = Counter((asking[i], of[j]) for i, j in zip(q, w))
            want = Counter((a, b) for a in asking for b in of if one_edit(a, b) and a[: length // 2] == b[: length // 2])
            assert got == want


def test_dead_prefixes():
    r = random.Random(4)
    for _ in range(3000):
        q, p = ("".join(r.choices("ab", k=r.randint(a, 8))) for a in (5, 0))
        alive = any(one_edit(q[:k], p) or q[:k] == p for k in range(len(q) + 1))
        dead = spelling.dead_at(q, p)
        assert (dead == 0) == alive
        if dead:
            assert not any(one_edit(q[:k], p[:dead]) or q[:k] == p[:dead] for k in range(len(q) + 1))
            assert spelling.dead_at(q, p[: dead - 1]) == 0


@pytest.mark.parametrize("shown", [200, 3])
def test_every_near_word_lies_in_a_block_the_word_goes_to(monkeypatch, shown):
    monkeypatch.setattr(spelling, "SHOWN", shown)
    words = made(7, "abcd", 250)
    lists = sorted((d, len(w), w if d == 0 else w[::-1]) for w in words for d in (0, 1))
    blocks = [lists[i : i + 9] for i in range(0, len(lists), 9)]
    directory = spelling.Directory([(b[0][0], b[0][1], b[0][2][:shown]) for b in blocks], list(range(len(blocks))))
    where = {x: i for i, b in enumerate(blocks) for x in b}
    visits = 0
    for w in words:
        for d, key in enumerate((w, w[::-1])):
            for size in (len(w) - 1, len(w), len(w) + 1):
                to = list(directory.route(d, size, key, len(w) // 2))
                visits += len(to)
                assert len(to) == len(set(to))
                for v in words:
                    k = v if d == 0 else v[::-1]
                    if len(v) == size and one_edit(w, v) and k[: len(w) // 2] == key[: len(w) // 2]:
                        assert where[d, size, k] in to
    assert shown == 3 or visits < 6 * len(words) * 4


def odd_rows():
    r = random.Random(3)
    words = made(5, "abé", 60) + made(6, "xyz", 10, 20, 30) + ["pre" + w for w in made(8, "abcd", 100)]
    texts = [None, "", " \n", "12345 !!", "Wordy WORDY wordy Wörde", "É" * 6, "×÷×÷× ×÷×÷×", "short four abcde-abcde-abcde", "漢字漢字漢字 кириллица", "long" * 60_000]
    texts += [" ".join(r.choices(words[: r.randint(1, len(words))], k=400)) for _ in range(40)]
    out = [(i, t, "clash", "clash", "clash", "clash") for i, t in enumerate(texts)]
    out += [out[-1], out[-1], (None, " ".join(words), None, None, None, None), (None, None, None, None, None, None), (-3, texts[-1] + " " + "long" * 60_000, "", "", "", ""), (-4, "long" * 60_000, "", "", "", "")]
    return out


@pytest.mark.parametrize("block", [spelling.BLOCK, 40])
def test_odd_rows_equal_plain_version(spark, monkeypatch, block):
    monkeypatch.setattr(spelling, "BLOCK", block)
    got = Counter(map(tuple, spelling.spelling_variants(spark.createDataFrame(odd_rows(), DOCS).repartition(3)).collect()))
    want = plain([(r[0], r[1]) for r in odd_rows()])
    assert got == Counter(want)
    assert any(w[3] and w[5] != w[3] for w in want)


def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    df = spelling.op11_spelling_variants(spark, sf)
    rel = con.sql(spelling.OP11_SQL)
    assert df.columns == rel.columns
    got = Counter(map(tuple, df.collect()))
    assert got == Counter(rel.fetchall())


def test_roots_of_long_chains(spark):
    chain = [(f"w{i:03}", f"w{i + 1:03}") for i in range(100)]
    got = {r.word: r.root for r in spelling.roots(spark.createDataFrame([*chain, ("x", "y")], "word string, form string"), Scratch(spark, "t")).collect()}
    assert got == {**{w: "w100" for w, _ in chain}, "x": "y"}


def test_empty_table(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], DOCS)).collect() == []
