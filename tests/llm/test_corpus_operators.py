"""Each operator against a plain version, on the smallest tables and on rows that are odd in every way."""

import hashlib
import html
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest

from fieldhouse.llm import ctw_score, hnsw_dedup, html_extract, mixing, ngram_join, packing, quality_rules, registry, substring_dedup, token_counts, url_filter
from fieldhouse.llm.common import Scratch, components

WORDS = [f"w{i}" for i in range(400)]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words string, component_id string"


def odd_rows():
    """Nulls, empty and long texts, ties, repeated rows, copies, shared passages, clashing extra columns."""
    r = random.Random(5)
    passage = " ".join(r.choices(WORDS, k=60))
    long_ = " ".join(r.choices(WORDS, k=30_000))
    base = r.choices(WORDS, k=200)
    texts = [None, "", "   \n\t ", "one", "One", "two words", "three short words", "ÀÉ  \x0b<|endoftext|> Σ ς\x1c x", "a b c " * 30, passage, "x " + passage, passage + " y\n\nz", long_, long_ + " tail", "naïve café " * 20 + "\u3000漢字 кириллица"]
    for i in range(12):
        t = list(base)
        t[10 + i] = f"changed{i}"
        texts.append(" ".join(t))
    texts += [" ".join(base)] * 5
    rows = [(i, t, ["en", None, "fr"][i % 3], ["s0", "s0", None, "s1"][i % 4], len(t or ""), "clash", "clash") for i, t in enumerate(texts)]
    rows.append(rows[9])
    rows.append((None, "no id at all", None, None, 0, None, None))
    rows.append((None, None, None, None, None, None, None))
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def plain(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def words(t):
    return (t or "").encode().split()


@pytest.fixture(params=["odd", "plain", "empty"])
def docs(request):
    return request.getfixturevalue(request.param)


# ---------------------------------------------------------------- helpers


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, 3), (3, 9), (200, 100), (5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    assert got == {**dict.fromkeys(range(100, 161), 100), 200: 100, 3: 3, 7: 3, 9: 3}
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0


# ---------------------------------------------------------------- 1


def test_url_filter(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    df = url_filter.op1_url_filter(spark, sf)
    assert Counter(map(tuple, df.collect())) == Counter(con.sql(url_filter.OP1_SQL).fetchall())


def test_url_filter_odd(spark):
    urls = [None, "", "example.org/es/", "http://EXAMPLE.org/es/a?x", "https://a.b.example.org/en/1", "http://example.org/en/12#f", "http://example.org/en/2", "http://notexample.org/es/x", "x://com/fr/", "http://a.com/de/?/fr/", "http://example.org", "http://org/", "a://b://org/", "http://example.org?/es/"]
    rows = [(i, u, "clash") for i, u in enumerate(urls)] + [(3, urls[3], "clash")]
    p = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(p, url_filter.rule_table(spark, url_filter.RULES)).collect()), key=str)
    want = []
    for i, u, _ in rows:
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
        fit = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        _, rule, verdict = max(fit) if fit else (0, None, "allow")
        want.append((i, host, path, rule, verdict))
    assert got == sorted(want, key=str)
    none = spark.createDataFrame([], "verdict string, host string, path string")
    assert {r.verdict for r in url_filter.judge_urls(p, none).collect()} == {"allow"}
    assert url_filter.judge_urls(p.limit(0), url_filter.rule_table(spark, url_filter.RULES)).count() == 0


def test_url_filter_is_native(spark, sf):
    plan = url_filter.op1_url_filter(spark, sf)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|NestedLoop|Cartesian", plan)


# ---------------------------------------------------------------- 2


def test_packing(docs):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(packing.tokenizer_paths()[0])
    rows = packing.pack(docs, *packing.tokenizer_paths()).collect()
    want, total = Counter(), 0
    for i, t in pairs(docs):
        ids = np.array([*tk.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        total += len(ids)
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        for k, (a, z) in enumerate(zip(cuts, cuts[1:])):
            want[i, k, a, z - a, zlib.crc32(ids[a:z].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    seqs = defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 2048
    assert len(seqs) <= 1.02 * total / 2048 + 2


def test_packing_plan_is_best_fit():
    r = random.Random(3)
    lengths = [r.choice([r.randint(1, 50), r.randint(1, 20)]) for _ in range(500)]
    bins = []
    for n in sorted(lengths, reverse=True):
        fit = [b for b in bins if b[0] >= n]
        b = min(fit, key=lambda b: b[0]) if fit else None
        if b is None:
            bins.append(b := [50])
        b[0] -= n
    steps = packing.plan(Counter(lengths), 50)
    used = {first + i for _, _, n, first, each, _ in steps for i in range(-(-n // each))}
    assert used == set(range(len(bins)))
    assert sum(s[2] for s in steps) == len(lengths)


# ---------------------------------------------------------------- 3


def test_html_extract(spark, sf):
    got = {r.page_id: r for r in html_extract.op3_html_extract(spark, sf).collect()}
    for x in spark.read.parquet(f"{sf}/pages.parquet").collect():
        a = re.search(r"<article>(.*?)</article>", x.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", a)]
        want = "\n\n".join(b for b in blocks if b)
        assert (got[x.page_id].text, got[x.page_id].n_chars, got[x.page_id].url) == (want, len(want), x.url)


PAGES = [
    ("http://a.x/1", "<html><body><header>H</header><div id='main-menu'><a href=x>m</a></div><main><h1>T &amp; U</h1><p>one<br>two<p>three <b>four</main><div class='comments'>c</div><form>f</form><footer>z</footer>", "T & U\n\none two\n\nthree four"),
    ("http://a.x/2", "<body><div class=cookie-notice>We use</div><main><ul><li>a<li>b</ul><aside>s</aside><pre>  x\n y </pre></main>", "a\n\nb\n\nx y"),
    ("http://a.x/3", None, ""),
    (None, "", ""),
    (None, "just text &lt;b&gt; & more", "just text <b> & more"),
    ("http://b.x/1", "<div><p>unclosed <i>tags <script>if (a<b) '</p>'</script>here<!-- gone --> too</div>", "unclosed tags here too"),
    ("http://b.x/2", "<div" * 3 + "<p>ok", None),
    ("http://c.x/1", "<div>" * 3000 + "deep" + "</div>" * 3000, "deep"),
]


def test_html_extract_odd(spark):
    rows = [(i, u, h, "clash") for i, (u, h, _) in enumerate(PAGES)] + [(0, *PAGES[0][:2], "clash")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((r.page_id, r.text) for r in html_extract.extract_text(d).collect())
    assert len(got) == len(rows)
    for i, t in got:
        if PAGES[i][2] is not None:
            assert t == PAGES[i][2]
    assert html_extract.extract_text(d.limit(0)).count() == 0


def test_html_extract_templates_of_one_host(spark):
    """A page follows its own template, whatever the host's other pages have; repeats of a page are no boilerplate."""
    body = [f"long enough text of page {i} " * 4 for i in range(20)]
    kinds = ["<article><p>{}</p></article>", "<main><p>{}</p></main>", "<div class=content><p>{}</p></div>", "<section><p>{}</p></section>"]
    rows = [(i, "http://m.x/1", "<body><nav>n</nav>" + kinds[i % 4].format(t) + "<footer>f</footer></body>") for i, t in enumerate(body)]
    rows += [(100 + i, "http://r.x/1", "<body><div><p>one page, many times</p></div></body>") for i in range(6)]
    rows += [(200 + i, "http://s.x/1", f"<body><div><p>{body[i]}</p></div><div><p>alike everywhere</p></div></body>") for i in range(6)]
    got = {r.page_id: r.text for r in html_extract.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(20)] == [t.strip() for t in body]
    assert {got[100 + i] for i in range(6)} == {"one page, many times"}
    assert [got[200 + i].split("\n")[0] for i in range(6)] == [t.strip() for t in body[:6]]


def test_wrapper_expression():
    pages = ["<div><ul><li>a<li>b</ul><p>x</div>", "<div><ul><li>a</ul><h2>q</h2><p>x<p>y</div>"]
    shapes = [html_extract.shape(html_extract.read(p)) for p in pages]
    html_extract._add(shapes[0], shapes[1])
    assert html_extract.expression(shapes[0]) == "<div><ul>(<li>#</li>)+</ul>(<h2>#</h2>)?(<p>#</p>)+</div>"


# ---------------------------------------------------------------- 4


def brute_dedup(rows, n=35):
    c = Counter(tuple(w[i : i + n]) for _, t in rows for w in [words(t)] for i in range(len(w) - n + 1))
    out = []
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - n + 1):
            if c[tuple(w[k : k + n])] > 1:
                gone[k : k + n] = [True] * n
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return Counter(out)


def test_substring_dedup(docs):
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.dedup(docs).collect())
    assert got == brute_dedup(pairs(docs))


def test_substring_dedup_text_and_batches(odd):
    a = substring_dedup.dedup(odd, batches=3, carry=["lang"])
    want = brute_dedup(pairs(odd))
    rows = a.collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in rows) == want
    for r in rows:
        if r.kept_text is not None:
            assert hashlib.sha256(b" ".join(words(r.kept_text))).hexdigest() == r.kept_sha256


# ---------------------------------------------------------------- 5


def test_hnsw(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(60, 24))
    x = np.concatenate([centres[rng.integers(0, 60, 900)] + 0.12 * rng.normal(size=(900, 24)), rng.normal(size=(600, 24)), centres[:1] + 0.05 * rng.normal(size=(300, 24))]).astype(np.float32)
    rows = [(i, v.tolist(), "clash") for i, v in enumerate(x)]
    rows += [(5000, rows[0][1], None), (5001, rows[0][1], None), (5002, None, None), (5003, [0.0] * 24, None), (5004, [float("nan")] * 24, None), (5005, [1.0, None], None), (5006, [1.0], None), (5007, [2.0], None), (None, [float("inf")] * 24, None)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, kept string")
    got = {r.vec_id: r for r in hnsw_dedup.near_duplicates(d, shards=3).collect()}
    assert len(got) == len(rows)
    ids = np.array([r[0] for r in rows[:1802]])
    u = np.array([r[1] for r in rows[:1802]], np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = u @ u.T >= 0.9
    np.fill_diagonal(s, False)
    found = sum(got[i].n_links for i in ids)
    assert 0.97 * s.sum() <= found <= s.sum()
    assert all(got[i].n_links <= s[k].sum() for k, i in enumerate(ids))
    comp = np.arange(len(ids))
    while True:
        new = np.minimum(comp, np.array([comp[s[i]].min(initial=comp[i]) for i in range(len(ids))]))
        if (new == comp).all():
            break
        comp = new
    assert np.mean([got[i].component_id == ids[comp[k]] for k, i in enumerate(ids)]) > 0.97
    for i in (5002, 5003, 5004, 5005, None):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert (got[5006].n_links, got[5007].component_id, got[5007].kept) == (1, 5006, False)
    assert hnsw_dedup.near_duplicates(d.limit(0)).count() == 0


def test_hnsw_failed_audit_goes_on_to_brute_force(monkeypatch):
    """Few queries have links, and the graph finds none of them at any beam."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 24))
    x[:20] = x[20:40] + 0.01 * rng.normal(size=(20, 24))
    rows = pd.DataFrame({"_id": np.arange(1500), "vec": list(x), "n": 1, "shard": 0})
    monkeypatch.setattr(hnsw_dedup.Graph, "search", lambda self, q, beam, *a: (np.zeros((len(q), beam), np.int64), np.full((len(q), beam), -2.0, np.float32)))
    index = pd.DataFrame({"blob": [hnsw_dedup._pack(x=hnsw_dedup._unit(rows["vec"]), id=np.arange(1500), n=np.ones(1500, np.int64), sizes=np.array([1500]), links0=np.zeros((1500, 24), np.int32))]})
    got = hnsw_dedup.query_shard(0.9, 0.99)(rows[["_id", "vec"]], index)
    assert dict(got[got.other.isna()][["_id", "links"]].itertuples(index=False)) == dict.fromkeys(range(40), 1)


# ---------------------------------------------------------------- 6


def test_mixing(docs):
    rows = mixing.mix(docs, {"s0": 3.0, "s1": 1.0}, block_bytes=500, slots=20).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in pairs(docs))
    by = defaultdict(set)
    for r in rows:
        by[r.slot].add((r.source, r.block))
    assert all(len(v) == 1 for v in by.values())
    for s in {r.source for r in rows}:
        order = sorted((r.block, r.slot) for r in rows if r.source == s)
        assert all(a[1] <= b[1] for a, b in zip(order, order[1:]))


def test_pfair_lag():
    weights = {f"s{i}": w for i, w in enumerate([5, 3, 2, 1, 1, 0.5])}
    e = mixing.shares(weights, 1000)
    assert sum(e.values()) == 1000
    assert all(abs(e[s] - 1000 * w / sum(weights.values())) < 2 for s, w in weights.items())
    places = mixing.period(e, 1000)
    assert sorted(p for x in places.values() for p in x) == list(range(1000))
    for s, x in places.items():
        done = np.zeros(1000)
        done[x] = 1
        assert np.abs(np.cumsum(done) - e[s] * np.arange(1, 1001) / 1000).max() < 1


def test_mixing_plan_places_every_block():
    blocks = {"a": 10, "b": 700, "c": 1, "d": 33}
    used = []
    for s, first, n, start, slots, places in mixing.plan(blocks, {"a": 1.0, "b": 5.0, "c": 2.0, "d": 0.0}, 50):
        for i in range(n):
            used.append(start + i // len(places) * slots + places[i % len(places)])
    assert len(used) == len(set(used)) == sum(blocks.values())
    assert max(used) == len(used) - 1


# ---------------------------------------------------------------- 7


def test_token_counts(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(token_counts.TOKENIZER)
    tk = Tokenizer.from_file(path)
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(docs, path).collect())
    want = Counter()
    for i, t in pairs(docs):
        n = len(tk.encode(t or "", add_special_tokens=False).ids)
        want[i, len((t or "").encode()), n, n > 2048] += 1
    assert got == want


def test_prefix_counts():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(token_counts.TOKENIZER)
    c, tk = token_counts.PrefixCounter(path), Tokenizer.from_file(path)
    for t in ["Hello there, the world's 3 wide-open thhorions", "a  b\nc\t d's", "unbelievable<|endoftext|>x y", "élan Vital ʼn"]:
        assert c.prefixes(t).tolist() == [len(tk.encode(t[:i], add_special_tokens=False).ids) for i in range(len(t) + 1)]
        assert c.ends(t)[-1] == c.count(t)


def test_words_within(spark):
    import public_tokenizers

    d = spark.createDataFrame([(1, "the cat sat on the unbelievable mat")], "doc_id long, text string")
    r = token_counts.token_counts(d, public_tokenizers.path(token_counts.TOKENIZER), prefixes=True)
    assert r.select(token_counts.words_within("word_ends", 3).alias("n")).first().n == 3


# ---------------------------------------------------------------- 8


def brute_quality(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    g = [False] * len(w)
    for i in range(len(w) - 4):
        if c[tuple(w[i : i + 5])] > 1:
            g[i : i + 5] = [True] * 5
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), sum(g), len(w) < 10 or 100 * sum(g) > 20 * len(w)


def test_quality_counts(spark, sf, docs):
    rows = quality_rules.judge(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows)
    assert got == Counter((i, *brute_quality(t)) for i, t in pairs(docs))
    assert not any(r.kept and r.base_failed for r in rows)
    kept = quality_rules.keep(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in rows if r.kept)


def test_quality_thresholds_hold_their_risk(spark):
    assert quality_rules.upper_bound(0, 100, 0.05) == pytest.approx(1 - 0.05 ** (1 / 100))
    assert quality_rules.upper_bound(3, 50, 0.05) == pytest.approx(0.14784, abs=1e-3)
    r = random.Random(2)
    rows, labels = [], []
    for i in range(6000):
        good = i % 3 > 0
        w = [r.choice(WORDS) + ("***" if not good and r.random() < 0.8 else "") for _ in range(40)]
        rows.append((i, " ".join(w), "en"))
        if i % 2:
            labels.append((i, int(good), 0))
    labels += [(None, 1, 0), (3, None, 0), (6001, 1, 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = quality_rules.judge(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    good = [x for x in got if x.doc_id % 3 > 0]
    bad = [x for x in got if x.doc_id % 3 == 0]
    assert sum(not x.kept for x in good) <= 0.05 * len(good)
    assert sum(x.kept for x in bad) <= 0.05 * len(bad)


# ---------------------------------------------------------------- 9


def brute_link(rows, k, num):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(zip(*[w[j:] for j in range(k)])) if len(w) >= k else frozenset([tuple(w)]) if w else frozenset())
    low = [(-(2**63) if i is None else i) for i, _ in rows]
    up = list(range(len(rows)))

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                up[root(a)] = root(b)
    comp = defaultdict(lambda: 2**63)
    for a in range(len(rows)):
        comp[root(a)] = min(comp[root(a)], low[a])
    return Counter((rows[a][0], len(sets[a]), None if comp[root(a)] == -(2**63) else comp[root(a)]) for a in range(len(rows)))


@pytest.mark.parametrize(("k", "num"), [(3, 90), (5, 80)])
def test_ngram_join(docs, k, num):
    got = Counter(map(tuple, ngram_join.link(docs, k, num).select("doc_id", "n_shingles", "component_id").collect()))
    assert got == brute_link(pairs(docs), k, num)


def test_ngram_join_near_copies(spark):
    """Borderline copies of a few texts: chains, stars and misses."""
    r = random.Random(9)
    rows = []
    for b in range(4):
        base = r.choices(WORDS, k=120)
        for i in range(25):
            t = list(base)
            for _ in range(r.randint(0, 4)):
                t[r.randrange(120)] = r.choice(WORDS)
            rows.append((b * 100 + i, " ".join(t)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    for k, num in ((3, 90), (5, 80)):
        got = Counter(map(tuple, ngram_join.link(d, k, num).collect()))
        assert got == brute_link(rows, k, num)


# ---------------------------------------------------------------- 10


def test_ctw_base(docs):
    rows = ctw_score.score(docs).collect()
    ps = pairs(docs)
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    c = Counter()
    for i, t in ps:
        if not held(i):
            c.update([*(t or "").encode().lower().split(), None])
    n, v = sum(c.values()), len(c)
    want = defaultdict(list)
    for i, t in ps:
        w = [*(t or "").encode().lower().split(), None]
        base = sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        want[i, held(i), len(w), sum(c[x] > 0 for x in w), n].append(base)
    got = defaultdict(list)
    for r in rows:
        got[r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens].append(r.base_score)
        assert r.score < 0
    assert got.keys() == want.keys()
    for k in want:
        assert sorted(got[k]) == pytest.approx(sorted(want[k]), rel=1e-9)


def brute_ctw(train, depth):
    """node (context bytes newest first, bit prefix) -> [zeros, ones]; the probability of a text by direct recursion."""
    counts = defaultdict(lambda: [0, 0])
    kids = defaultdict(set)

    def bits(b):
        for j in range(8):
            yield (1 << j) | (b >> (8 - j)), (b >> (7 - j)) & 1

    def walk(t):
        s = b"\n" * depth + ctw_score.canonical(t)
        for i in range(depth, len(s)):
            yield s[i], bytes(s[i - 1 - d] for d in range(depth))

    for t in train:
        for b, ctx in walk(t):
            for node, bit in bits(b):
                for d in range(depth + 1):
                    counts[ctx[:d], node][bit] += 1
                    if d:
                        kids[ctx[: d - 1], node].add(ctx[:d])

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    memo = {}

    def lw(ctx, node):
        if (ctx, node) not in memo:
            k = kt(*counts[ctx, node])
            if len(ctx) < depth:
                below = sum(lw(c, node) for c in kids[ctx, node])
                top = max(k, below)
                memo[ctx, node] = (top + math.log(0.5 * math.exp(k - top) + 0.5 * math.exp(below - top)), k, below)
            else:
                memo[ctx, node] = (k, k, None)
        return memo[ctx, node][0]

    def one(ctx, node, d=0):
        if (ctx[:d], node) not in counts:
            return 0.5
        lw(ctx[:d], node)
        _, k, below = memo[ctx[:d], node]
        a, b = counts[ctx[:d], node]
        p = (b + 0.5) / (a + b + 1)
        if below is None:
            return p
        w = 1 / (1 + math.exp(min(below - k, 700)))
        return w * p + (1 - w) * one(ctx, node, d + 1)

    def score(t):
        total = 0.0
        for b, ctx in walk(t):
            for node, bit in bits(b):
                p = one(ctx, node)
                total += math.log10(p if bit else 1 - p)
        return total

    return score


@pytest.mark.parametrize("depth", [1, 3, 4, ctw_score.DEPTH])
def test_ctw_equals_direct_recursion(spark, depth):
    rows = [(i, t) for i, t in enumerate(["the cat sat on the mat", "the dog sat", None, "", "A cat and a dog; the mat", "zebra 42 the", "the the the", "the cat sat on the mat", "\u6f22\u5b57 caf\u00e9"])]
    got = {r.doc_id: r.score for r in ctw_score.score(spark.createDataFrame(rows, "doc_id long, text string"), depth=depth).collect()}
    brute = brute_ctw([(t or "").encode() for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1], depth)
    for i, t in rows:
        assert got[i] == pytest.approx(brute((t or "").encode()), rel=1e-9)


def test_ctw_blocks_and_groups_do_not_matter(spark, plain, monkeypatch):
    want = sorted((r.doc_id, r.score) for r in ctw_score.score(plain).collect())
    monkeypatch.setattr(ctw_score, "CHUNK_BYTES", 1 << 16)
    got = sorted((r.doc_id, r.score) for r in ctw_score.score(plain).collect())
    assert [i for i, _ in got] == [i for i, _ in want]
    assert [x for _, x in got] == pytest.approx([x for _, x in want], rel=1e-9)
    texts = [t.encode() for t in ("a long text " * 50, "", "b")]
    whole = [(f + int(w), int(k)) for f, who, key in ctw_score.coded(texts, 6) for w, k in zip(who, key, strict=True)]
    monkeypatch.setattr(ctw_score, "BLOCK_BYTES", 7)
    assert whole == [(f + int(w), int(k)) for f, who, key in ctw_score.coded(texts, 6) for w, k in zip(who, key, strict=True)]


def brute_lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_html_alignment_is_a_longest_common_subsequence():
    r = random.Random(3)
    for n in [0, 1, 5, 40, 300]:
        for letters in ("ab", "abcdefgh"):
            a, b = r.choices(letters, k=n), r.choices(letters, k=r.randint(0, n))
            got = html_extract.common(a, b)
            assert all(a[i] == b[j] for i, j in got) and len(got) == brute_lcs(a, b)
            assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:], strict=False))
    a, b = r.choices("abcde", k=6000), r.choices("abcde", k=5000)
    got = html_extract.common(a, b)
    assert len(got) > 3000 and all(a[i] == b[j] for i, j in got)


def test_html_deep_pages_and_ambiguous_names(spark):
    deep = "<body>" + "<div>" * 400 + "<nav>menu</nav><p>deep text here</p>" + "</div>" * 400 + "</body>"
    pages = [(i, f"http://a{i}.org/", f"{deep}{i}") for i in range(2)]
    story = "<body><nav>menu</nav><div class='story'><p>first {0}</p><div class='related-work'><p>kept content {0}</p></div><div class='related-posts'>go {0}</div></div></body>"
    pages += [(10 + i, "http://b.org/", story.format(i)) for i in range(3)]
    got = {r.page_id: r.text for r in html_extract.extract_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[0].startswith("deep text here") and "menu" not in got[0]
    assert got[11] == "first 1\n\nkept content 1"


def test_token_counts_long_words_and_all_scripts():
    import public_tokenizers

    c = token_counts.counter(public_tokenizers.path(token_counts.TOKENIZER))
    r = random.Random(9)
    scripts = ["abcXYZ019", "\u0430\u0431\u0432\u0414", "\u6f22\u5b57\u4eee", "\u03b1\u03c2\u03a3", "\u201c\u2019\u2026", "\U0001f642", "\t\x0b\u3000 \n", "\u0627\u0644", "<|>"]
    for _ in range(2000):
        t = "".join(r.choice(r.choice(scripts)) for _ in range(r.randint(1, 30)))
        assert c.count(t) == len(c.library.encode(t, add_special_tokens=False).ids)
    long_ = "".join(r.choice("ACGT") for _ in range(20_000))
    assert c.count(long_) == len(c.library.encode(long_, add_special_tokens=False).ids)
    assert c.count(long_ * 50) > 0 and max(map(len, c.states)) <= token_counts.SHARED and max(map(len, c.words)) <= token_counts.SHARED


def test_mixing_null_source_is_its_own_and_slots_equal_a_plain_schedule(spark):
    r = random.Random(4)
    rows = [(i, "x" * r.randint(0, 300), [None, "", "a", "a", "a", "b"][i % 6]) for i in range(600)]
    weights = {None: 1.0, "": 2.0, "a": 3.0, "b": 4.0}
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights, block_bytes=500, slots=50).collect()
    assert {x.source for x in got} == {None, "", "a", "b"} and sorted(x.doc_id for x in got) == list(range(600))
    text = {i: t for i, t, _ in rows}
    blocks, slot_of = Counter(), defaultdict(set)
    for s in (None, "", "a", "b"):
        mine = sorted((x for x in got if x.source == s), key=lambda x: x.place)
        at = 0
        for x in mine:  # places are the running size, blocks follow from them
            assert x.place == at and x.block == at // 500
            at += max(1, len(text[x.doc_id]))
            slot_of[s, x.block].add(x.slot)
        blocks[s] = (at - 1) // 500 + 1
    assert all(len(v) == 1 for v in slot_of.values())
    # one slot at a time: of the blocks released, the one due first
    key = mixing.named_key
    left, done, start = dict(blocks), Counter(), 0
    want = {}
    while any(left.values()):
        live = {s: left[s] for s in left if left[s]}
        now = min(max(50, 2 * len(live)), max(sum(live.values()), len(live)))
        e = mixing.shares({key(s): weights[s] for s in live}, now)
        used = Counter()
        for t in range(now):
            ready = [(-(-(used[s] + 1) * now // e[key(s)]), key(s), s) for s in live if used[s] < e[key(s)] and used[s] * now // e[key(s)] <= t]
            if not ready:
                continue
            s = min(ready)[2]
            want[s, done[s]] = start + t
            used[s] += 1
            done[s] += 1
            left[s] -= 1
            if not left[s]:
                break
        start += t + 1
    assert {k: v for k, (v,) in slot_of.items()} == {k: want[k] for k in slot_of}


def test_quality_verdict_equals_plain_thresholds(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality_rules.judge(docs, labels, alpha=0.3, delta=0.3).collect()
    info = {r.doc_id: (r.lang, r.text or "") for r in docs.collect()}
    good = {r.doc_id for r in labels.where("quality = 1").collect()}

    def values(r):
        n = max(r.n_words, 1)
        lines = [x for x in info[r.doc_id][1].split("\n") if x.strip(" \t\n\r\x0b\x0c")]
        return {"symbols_per_word": r.n_symbols / n, "dup_line_share": r.n_dup_lines / max(len(lines), 1), "repeat_word_share": r.n_repeat_words / n, "long_words": r.word_chars / n, "short_words": -r.word_chars / n}

    strata = {info[r.doc_id][0] for r in rows if r.doc_id in good}
    tests = len(strata) * sum(map(len, quality_rules.GRIDS.values()))
    cuts = {}
    for s in strata:
        mine = [values(r) for r in rows if r.doc_id in good and info[r.doc_id][0] == s]
        for rule, grid in quality_rules.GRIDS.items():
            for cut in grid:
                bad = sum(v[rule] > cut for v in mine)
                p = 0.3 / len(quality_rules.GRIDS)
                # the bound is at most p where so few are improbable at p
                tail = sum(math.exp(math.lgamma(len(mine) + 1) - math.lgamma(i + 1) - math.lgamma(len(mine) - i + 1) + i * math.log(p) + (len(mine) - i) * math.log1p(-p)) for i in range(bad + 1))
                if bad < len(mine) and tail <= 0.3 / tests:
                    cuts[s, rule] = cut
                    break
    assert cuts
    for r in rows:
        gone = [k for k, v in values(r).items() if v > cuts.get((info[r.doc_id][0], k), math.inf)]
        assert r.kept == (not r.base_failed and not gone)


# ---------------------------------------------------------------- registry


def test_all_operators_registered():
    assert {int(re.match(r"op(\d+)_", k)[1]) for k in registry.QUERIES} == set(range(1, 14))
