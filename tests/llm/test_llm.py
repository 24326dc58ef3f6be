"""Each operator against a brute-force version, and its defined cases."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest
from pyspark.sql import functions as F

from memlake.llm import classifier, decontam, hpylm, linear, lines, mixing, nearjoin, quality, queries, stirling, textkit as tk, tokens, toxicity, urls
from memlake.llm.components import components

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, a column whose name clashes with a measure."""
    long = " ".join(f"w{i % 977} the of" for i in range(7000))
    rows = [(1, None, None, None, 0, "x"), (2, "", "en", "a", 0, "x"), (3, " \n\t ", "en", "a", 0, None), (4, long, "en", "b", len(long), "x"), (5, "one two", "en", "a", 7, "x"),
            (5, "one two", "en", "a", 7, "x"), (None, "one two", None, "a", 7, "x"), (6, "é一\U0001f600 " * 30, "en", None, 0, "x"), (7, long + " tail", "en", "b", 0, "x")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# kernels
def test_words_and_hashes():
    texts = ["A bc  d", "", None, "\tx\n", "y"]
    block = next(tk.blocks(pa.array(texts)))
    s, e, o = tk.words(block.data, block.offsets)
    assert [(bytes(block.data[a:b]).decode(), i) for a, b, i in zip(s, e, o)] == [("A", 0), ("bc", 0), ("d", 0), ("x", 3), ("y", 4)]
    h = tk.span_hashes(block.data, s, e)
    again = next(tk.blocks(pa.array(["zz bc d bc"])))
    s2, e2, _ = tk.words(again.data, again.offsets)
    h2 = tk.span_hashes(again.data, s2, e2)
    assert h2[1] == h[1] == h2[3] and h2[2] == h[2] and h2[0] not in h


def test_shingles_of_short_texts():
    block = next(tk.blocks(pa.array(["a b", "b a", "a", "", "a b c d e", "a b"])))
    s, e, o = tk.words(block.data, block.offsets)
    h, at = tk.shingles(tk.span_hashes(block.data, s, e), o, len(block), 4)
    h, off = tk.distinct_per_text(h, at, len(block))
    sets = [set(h[off[i] : off[i + 1]].tolist()) for i in range(6)]
    assert [len(x) for x in sets] == [1, 1, 1, 0, 2, 1] and sets[0] == sets[5] != sets[1]


def test_components(spark):
    random.seed(2)
    e = [(random.randrange(300), random.randrange(300)) for _ in range(160)] + [(400 + i, 401 + i) for i in range(40)]
    up = {}

    def top(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in e:
        x, y = top(a), top(b)
        up[max(x, y)] = min(x, y)
    got = {r["v"]: r["root"] for r in components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert got == {v: top(v) for v in up if any(v in p and p[0] != p[1] for p in e)}


# 1 mixing
def test_targets_by_hand(spark):
    t = spark.createDataFrame([("a", 10), ("b", 100), (None, 40), ("a", 5)], "source string, size long")
    got = {r["source"]: (r["source_size"], r["target"]) for r in mixing.targets(t).collect()}
    # 232.5 words by 5, 2, 1: a stops at 30, then 202.5 by 2, 1: 135 and 67.5
    assert got == {"a": (15, 30.0), "b": (100, 135.0), None: (40, 67.5)}


def test_mix(spark, docs, odd, none):
    rows = mixing.mix(docs).toPandas()
    want = {r["doc_id"]: len(WORD.findall(r["text"] or "")) for r in docs.collect()}
    assert dict(zip(rows["doc_id"], rows["size"])) == want
    assert rows["copies"].between(0, 2).all() and math.isclose(rows.groupby("source")["target"].first().sum(), 1.5 * rows["size"].sum())
    for _, g in rows.groupby("source"):
        assert abs(g["taken"].sum() - g["target"].iloc[0]) <= g["size"].max()
    assert mixing.mix(docs).orderBy("doc_id").toPandas()["taken"].tolist() == rows.sort_values("doc_id")["taken"].tolist()
    assert mixing.mix(none).count() == 0
    assert mixing.mix(odd).count() == 9 and mixing.mixed(odd).columns == [*odd.columns, "copy"]


def test_mix_with_null_and_repeated_ids(spark):
    """Targets are met also where a third of all rows are one row, or all ids are null; columns may be called copy."""
    rng = random.Random(6)
    rows = [(None, f"{'w ' * rng.randint(1, 9)}{i}", f"s{i % 4}", "x") for i in range(600)] + [(7, "a b c d e", "s1", "x")] * 400 + [(i, "q r", "s9", "x") for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, copy string").repartition(3)
    got = mixing.mix(df).toPandas()
    assert len(got) == len(rows) and got["copies"].between(0, 2).all()
    for _, g in got.groupby("source"):
        assert abs(g["taken"].sum() - g["target"].iloc[0]) <= 10
    out = mixing.mixed(df)
    assert out.columns == ["doc_id", "text", "source", "copy", "_copy"]
    per = {r["source"]: r["n"] for r in out.groupBy("source").agg(F.sum(mixing.n_words(F.col("text"))).alias("n")).collect()}
    for s, g in got.groupby("source"):
        assert abs(per[s] - g["target"].iloc[0]) <= 10


def test_mix_thresholds_against_brute_force(spark, docs):
    """A source's documents in the order of their places are taken up to its target, the last if that comes nearer."""
    h = mixing.position(F.col("doc_id"), F.col("text"), F.monotonically_increasing_id())
    place = {r["doc_id"]: r["h"] for r in docs.select("doc_id", h.alias("h")).collect()}
    got = mixing.mix(docs).toPandas()
    for _, g in got.groupby("source"):
        target, size = float(g["target"].iloc[0]), int(g["source_size"].iloc[0])
        whole = int(target // size) if size else 0
        rest, taken = target - whole * size, set()
        for r in sorted(g.itertuples(), key=lambda r: place[r.doc_id]):
            if r.size > rest and not r.size - rest < rest:
                break
            taken.add(r.doc_id)
            if r.size > rest:
                break
            rest -= r.size
        assert {r.doc_id: r.copies for r in g.itertuples()} == {r.doc_id: min(2, whole + (r.doc_id in taken)) for r in g.itertuples()}


# 2 decontamination
def test_decontamination(spark, docs, odd, none):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    plain = lambda t: " ".join(WORD.findall(lower(t)))
    items = {r["item_id"]: plain(r["text"]) for r in bench.collect()}
    got = {r["doc_id"]: set(r["_items"]) for r in decontam.contamination(docs, bench).collect()}
    for r in docs.collect():
        t = plain(r["text"])
        assert {i for i, x in items.items() if x in t} <= got[r["doc_id"]]
    assert sum(map(bool, got.values())) < len(got) / 2
    assert decontam.contamination(none, bench).count() == 0
    assert decontam.contamination(odd, bench.limit(0)).filter(F.size("_items") > 0).count() == 0
    assert decontam.contamination(odd, bench).columns == [*odd.columns, "_items", "_edits"]


def test_edited_passages_are_found():
    random.seed(4)
    letters = "abcdefghij klmnop"
    items = [(i, "".join(random.choice(letters) for _ in range(150 + 20 * i))) for i in range(20)]
    index = decontam.Index([(i, t.encode()) for i, t in items])
    noise = lambda n: "".join(random.choice(letters) for _ in range(n))
    for i, t in items:
        x = list(t)
        for _ in range(int(0.04 * min(len(x), decontam.SEGMENT))):
            j = random.randrange(len(x))
            x[j : j + 1] = random.choice([[], ["z"], [x[j], "z"]])
        text = noise(300) + " " + "".join(x).upper() + "\n" + noise(200)
        hits = index.hits(next(tk.blocks(pa.array([noise(50), text]))))
        assert i in hits.get(1, {}) and 0 not in hits


def brute_distance(t, x):
    """Least edits between t and any region of x."""
    row = np.zeros(len(x) + 1, dtype=int)
    for i, c in enumerate(t, 1):
        new = np.minimum(row[:-1] + (np.frombuffer(x, np.uint8) != c), row[1:] + 1)
        new = np.append(i, new)
        row = np.minimum.accumulate(new - np.arange(len(x) + 1)) + np.arange(len(x) + 1)
    return int(row.min())


def test_decontamination_agrees_with_brute_force():
    """Texts with passages of 0 to 20 edits: found exactly where some segment is within its budget."""
    rng = random.Random(8)
    letters = "abcdefghijklmnopqrs tuv"
    word = lambda n: "".join(rng.choice(letters) for _ in range(n)).strip().replace("  ", " x")
    items = [(i, word(rng.randint(30, 320))) for i in range(12)]
    index = decontam.Index([(i, t.encode()) for i, t in items])
    texts = []
    for n in range(60):
        x = list(rng.choice(items)[1])
        for _ in range(rng.randint(0, 20)):
            j = rng.randrange(len(x))
            x[j : j + 1] = rng.choice([[], ["z"], [x[j], "z"]])
        texts.append(f"{word(rng.randint(5, 60))} {''.join(x)} {word(30)}")
    hits = index.hits(next(tk.blocks(pa.array(texts))))
    found = 0
    for d, t in enumerate(texts):
        block = next(tk.blocks(pa.array([t])))
        data = decontam.normalise(block.data, block.offsets)[0].tobytes()
        want = {}
        for segment, owners, k in zip(index.texts, index.items, index.edits.tolist(), strict=True):
            e = brute_distance(segment, data)
            if e <= k:
                for item in owners:
                    want[item] = min(e, want.get(item, e))
        assert hits.get(d, {}) == want
        found += bool(want)
    assert 10 < found < 60


def test_short_null_and_sliced_items(spark, monkeypatch):
    bench = spark.createDataFrame([(1, "tiny one"), (None, "the secret question of the day"), (2, None), (3, " "), (4, "another long benchmark item here")], "item_id long, text string")
    rows = [(1, "a Tiny  ONE here", "x", 0), (2, "tinyone tiny", "x", 0), (3, "ask the secret question of the day now", "x", 0), (4, "an another long benchmark item here, tiny one", "x", 0), (None, None, "x", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _items string, _EDITS int")
    want = {1: ([1], 0), 2: ([], None), 3: ([], 0), 4: ([1, 4], 0), None: ([], None)}
    for size in (decontam.SLICE_BYTES, 1):
        monkeypatch.setattr(decontam, "SLICE_BYTES", size)
        out = decontam.contamination(docs, bench)
        assert out.columns == [*docs.columns, "__items", "__edits"]
        assert {r["doc_id"]: (r[-2], r[-1]) for r in out.collect()} == want


# 3 line dedup
def brute_lines(rows):
    """Chunks by the same boundaries, dropped but for their first document's first."""
    cut = {}
    for k, t in rows:
        block = next(tk.blocks(pa.array([t])))
        raw = block.data.tobytes()
        cut[k] = [(raw[s:e], ok) for s, e, _, ok in lines.chunks(block)[0]]
    where = collections.defaultdict(list)
    for k in sorted(cut):
        for c, ok in cut[k]:
            if ok:
                where[c].append(k)
    out = {}
    for k in cut:
        seen, kept = set(), []
        for c, ok in cut[k]:
            if ok and len(where[c]) > 1 and (where[c][0] != k or c in seen):
                continue
            seen.add(c)
            kept.append(c)
        out[k] = b"\n".join(kept).decode()
    return out


def test_line_dedup(spark, docs, odd, none):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(docs).collect()}
    assert got == brute_lines(rows)
    assert any(got[k] != t for k, t in rows)
    out = lines.dedup_lines(odd)
    assert out.columns == [*odd.columns, "n_lines", "n_removed"] and out.count() == 9
    assert out.filter("doc_id = 1").first()["text"] is None and lines.dedup_lines(none).count() == 0


def test_shifted_passage_goes(spark):
    random.seed(5)
    line = lambda n: " ".join("".join(random.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    passage = [line(26) for _ in range(3)]
    rows = [(i, "\n".join([line(6) for _ in range(i + 1)] + passage + [line(7) for _ in range(3)])) for i in range(6)]
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for p in passage:
        assert [i for i, t in got.items() if p in t] == [0]
    assert all(len(got[i].split("\n")) == i + 4 for i in range(1, 6))


def test_line_chunks_do_not_depend_on_the_batch(spark):
    random.seed(11)
    line = lambda n: " ".join("".join(random.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    texts = ["\n".join(line(random.randint(2, 6)) for _ in range(random.randint(2, 9))) for _ in range(300)]
    alone = [lines.chunks(next(tk.blocks(pa.array([t]))))[0] for t in texts]
    for block in tk.blocks(pa.array(texts), 4000):
        begin = block.offsets[:-1].tolist()
        got = [[(s - b, e - b, k, ok) for s, e, k, ok in found] for b, found in zip(begin, lines.chunks(block), strict=True)]
        assert got == alone[block.first : block.first + len(block)]
    # copies under other neighbours, their join with the removals shuffled
    rows = list(enumerate(texts)) + [(1000 + i, t) for i, t in enumerate(random.sample(texts, len(texts)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(df).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert got == brute_lines(rows)


def test_boundaries_of_line_chunks():
    """Against a plain reading of the rule: a line ends a chunk if its roll is less than its neighbours', two lines from a text's ends."""
    rng = random.Random(12)
    for _ in range(60):
        text = "\n".join(" ".join(rng.choice("abcdef") for _ in range(rng.choice([1, 2, 3, 25]))) for _ in range(rng.randint(1, 14)))
        rows = text.split("\n")
        block = next(tk.blocks(pa.array([text])))
        one = lambda x: int(tk.span_hashes(np.frombuffer(x.encode(), np.uint8), np.array([0]), np.array([len(x.encode())]))[0])
        h = [one(x) for x in rows]
        roll = [(h[i] + (h[i - 1] * (0x9E3779B97F4A7C15 + 2) if i else 0)) % (1 << 64) for i in range(len(h))]
        value = [int(tk.mix(np.array([x], dtype=np.uint64))[0]) for x in roll]
        long = [len(x.split()) >= lines.LONG_LINE for x in rows]
        stops = [i for i in range(len(rows)) if i == len(rows) - 1 or long[i] or long[i + 1] or (1 <= i < len(rows) - 2 and value[i] < value[i - 1] and value[i] <= value[i + 1])]
        begins = [0, *[i + 1 for i in stops[:-1]]]
        want = ["\n".join(rows[a : b + 1]) for a, b in zip(begins, stops, strict=True)]
        raw = block.data.tobytes()
        found = lines.chunks(block)[0]
        assert [raw[s:e].decode() for s, e, _, _ in found] == want
        assert [ok for *_, ok in found] == [b > a or long[a] for a, b in zip(begins, stops, strict=True)]


def test_line_columns_do_not_clash(spark):
    df = spark.createDataFrame([(1, "a b\nc d", 5, "x"), (2, "a b\nc d", 6, "y")], "doc_id long, text string, n_lines int, N_removed string")
    out = lines.dedup_lines(df)
    assert out.columns == ["doc_id", "text", "n_lines", "N_removed", "_n_lines", "_n_removed"]
    assert {r["doc_id"]: (r["text"], r["n_lines"], r["_n_lines"], r["_n_removed"]) for r in out.collect()} == {1: ("a b\nc d", 5, 2, 0), 2: ("", 6, 2, 2)}


# 4 url filter
def test_urls(spark, none):
    rules = queries.URL_RULES
    cases = [None, "", "foo", "HTTP://A.Example.NET/en/x?y#z", "x://net", "x://net/", "://q.org/fr/?x", "a://b://net/en/", "h://planet/x", "h://a.org/fr/z", "h://example.net:80/en/", "h://example.com/de/a", "h://xexample.com/de/a", "h://a.example.com/DE/", "h://net./x"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(cases)] * 2, "page_id long, url string")

    def brute(u):
        if u is None or "://" not in u:
            return "", "", None, "allow"
        rest = u.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path, host = re.match(r"[^?#]*", rest[len(host) :])[0], lower(host)
        fit = [(len(h), len(p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, default=(0, 0, None, "allow"))
        return host, path, best[2], best[3]

    got = collections.Counter(tuple(r) for r in urls.apply_rules(pages, urls.rules_table(spark, rules), "page_id").select("page_id", "host", "path", "rule", "verdict").collect())
    assert got == collections.Counter((i, *brute(u)) for i, u in enumerate(cases) for _ in range(2))
    assert urls.apply_rules(pages.limit(0), urls.rules_table(spark, rules), "page_id").count() == 0
    assert urls.apply_rules(pages, urls.rules_table(spark, rules).limit(0), "page_id").filter("verdict = 'block'").count() == 0


def test_bloom_with_many_rules(spark):
    rules = [(f"h{i}.com", "/a/", "block") for i in range(3000)]
    pages = spark.createDataFrame([(i, f"http://w.h{i}.com/a/b") for i in range(0, 6000, 7)], "page_id long, url string")
    got = urls.apply_rules(pages, urls.rules_table(spark, rules), "page_id").filter("verdict = 'block'").select("page_id").collect()
    assert {r[0] for r in got} == set(range(0, 3000, 7))


# 5 near join
def brute_near(rows, k, percent):
    sets, inv, up, least = [], collections.defaultdict(list), {}, {}
    for i, (key, t) in enumerate(rows):
        w = WORD.findall(lower(t))
        s = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
        sets.append(s)
        up[i] = i

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, s in enumerate(sets):
        c = collections.Counter()
        for x in s:
            c.update(inv[x])
            inv[x].append(i)
        for j, n in c.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                up[top(i)] = top(j)
    for i, (key, _) in enumerate(rows):
        r = top(i)
        least[r] = min(key, least.get(r, key))
    return {key: (len(sets[i]), least[top(i)]) for i, (key, _) in enumerate(rows)}


def family(seed, n, words, rate):
    random.seed(seed)
    base = [random.choice("abcdefghijklmnop") * random.randint(1, 5) + str(random.randrange(40)) for _ in range(words)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(int(rate * (i % 7) * words)):
            w[random.randrange(len(w))] = f"x{random.randrange(10**6)}"
        out.append((1000 * seed + i, " ".join(w)))
    return out


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80)])
def test_near_join(spark, docs, k, percent):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for seed, n, words, rate in ((1000, 90, 60, 0.01), (2000, 60, 9, 0.03), (3000, 40, 300, 0.006), (4000, 50, 14, 0.02)):
        rows += family(seed, n, words, rate)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in nearjoin.near_join(df, k, percent, block=16).collect()}
    assert got == brute_near(rows, k, percent)


def test_near_join_deals_packed_blocks():
    """Near copies' elements are dealt to pairs of blocks in a small part of their bytes, and come back as they were."""
    tokens, rng = [], np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    for i in range(64):
        own = base.copy()
        own[rng.integers(0, 300, i % 12)] = rng.integers(0, 1 << 63, i % 12).astype(np.uint64)
        tokens.append(np.unique(own))
    ids = np.arange(64, dtype=np.int64) - 5
    raw = nearjoin.pack_block(ids, tokens)
    got_ids, got = nearjoin.unpack_block(raw)
    assert got_ids.tolist() == ids.tolist() and all((a == b).all() for a, b in zip(got, tokens, strict=True))
    assert len(raw) * 5 < sum(t.nbytes for t in tokens)


def test_shuffles_end_with_the_step(spark):
    import time

    from memlake.shared import CLEANUP, cut

    held = lambda: {str(f) for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if "shuffle_" in str(f)}
    before, conf = held(), spark.conf.get(CLEANUP)
    df, _ = cut(spark.range(100_000).groupBy((F.col("id") % 1000).alias("k")).count())
    until = time.time() + 20
    while held() - before and time.time() < until:
        time.sleep(0.2)
    assert not held() - before and df.count() == 1000 and spark.conf.get(CLEANUP) == conf


def test_near_join_cases(spark, odd, none):
    got = nearjoin.near_join(odd).toPandas()
    assert len(got) == 9 and nearjoin.near_join(none).count() == 0
    by = {r.doc_id: (r.n_shingles, r.component_id) for r in got.itertuples() if r.doc_id == r.doc_id}
    assert by[1] == (0, 1) and by[2] == (0, 2) and by[5] == (1, 5) and by[7][1] == 4
    assert got[got["doc_id"].isna()]["component_id"].tolist() == [5]


# 6 token counts
def test_token_counts_agree_with_the_public_implementation(spark, docs, odd, none):
    from tokenizers import Tokenizer, models, pre_tokenizers

    v = tokens.load_model()
    theirs = Tokenizer(models.Unigram(list(v.pieces), v.unknown, True))
    theirs.pre_tokenizer = pre_tokenizers.Metaspace("▁", "always", True)
    random.seed(1)
    texts = [r["text"] or "" for r in docs.collect()] + ["", " ", " a  b ", "héllo\n\nwörld", "\n", "\nb", "a\n \nb"] + ["".join(random.choice("ab \né一\U0001f600<>0x1▁") for _ in range(random.randint(0, 40))) for _ in range(300)]
    mine = tokens.Counter(v)
    for t in texts:
        assert mine.text(t)[1] == len(theirs.encode(t, add_special_tokens=False).ids), repr(t)
    assert tokens.count_tokens(odd).count() == 9 and tokens.count_tokens(none).count() == 0


def test_tie_rules_on_a_small_vocabulary():
    from tokenizers import Tokenizer, models, pre_tokenizers

    pieces = (("<unk>", -9.0), ("▁", -2.0), ("a", -1.0), ("b", -1.0), ("aa", -2.0), ("ab", -2.0), ("▁a", -3.0), ("aab", -3.0), ("ba", -1.5))
    theirs = Tokenizer(models.Unigram(list(pieces), 0, False))
    theirs.pre_tokenizer = pre_tokenizers.Metaspace("▁", "always", True)
    mine = tokens.Counter(tokens.Vocabulary(pieces, 0, False))
    random.seed(3)
    for _ in range(400):
        t = "".join(random.choice("aabbcd ") for _ in range(random.randint(0, 14)))
        assert mine.text(t)[1] == len(theirs.encode(t).ids), repr(t)


# 7 language model
def test_lm_scores(spark, docs, odd, none):
    got = {r["doc_id"]: r for r in hpylm.score_texts(docs).collect()}
    toks = {r["doc_id"]: [*WORD.findall(lower(r["text"])), None] for r in docs.collect()}
    held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k in toks}
    c = collections.Counter(w for k, t in toks.items() if not held[k] for w in t)
    n, v = sum(c.values()), len(c)
    better = 0
    for k, t in toks.items():
        r = got[k]
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[k], len(t), sum(c[w] > 0 for w in t), n)
        assert math.isclose(r["base_score"], base, rel_tol=1e-12) and r["score"] < 0
        better += held[k] and r["score"] > r["base_score"]
    assert better > 0.8 * sum(held.values())
    assert hpylm.score_texts(odd).count() == 9 and hpylm.score_texts(none).count() == 0


@pytest.mark.parametrize("order", [2, 3])
def test_lm_scores_do_not_depend_on_partitions(spark, docs, order):
    was, got = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n, parts, size in ((2, 1, 10**6), (9, 5, 3_000)):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            got.append({r["doc_id"]: r["score"] for r in hpylm.score_texts(docs.repartition(parts), order, size).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert got[0] == got[1]


@pytest.mark.parametrize("d", [0.05, 0.3, 0.6, 0.8, 0.95])
def test_stirling_numbers(d):
    s = stirling.table(d, 1500)
    for c in range(1, 7):  # rising factorials: sum over t of S(c, t) (theta | d)_t = (theta)_c
        theta = 1.7
        total = sum(math.exp(s[c, t]) * math.prod(theta + d * j for j in range(t)) for t in range(1, c + 1))
        assert math.isclose(total, math.prod(theta + j for j in range(c)), rel_tol=1e-9)
    for c in (65, 200, 1500):
        t = np.unique(np.append(np.rint(np.geomspace(1, c, 40)), c - 1))
        assert np.abs(stirling.log_s(np.full(len(t), float(c)), t, d) - s[c, t.astype(int)]).max() < 0.15


@pytest.mark.parametrize("c", [2, 30, 64, 65, 400])
def test_table_draws(c):
    """Means and spreads of the draws are those of p(t) = S(c, t) z ** t, for listed and for proposed numbers alike."""
    n, d = 20_000, 0.7
    key = tk.mix(np.arange(n).astype(np.uint64))
    for z in (0.02, 1.0, 30.0):
        t = np.arange(1, c + 1)
        log_p = stirling.table(d, 500)[c, 1 : c + 1] + t * np.log(z)
        p = np.exp(log_p - log_p.max())
        p /= p.sum()
        now = np.ones(n, np.int64)
        for salt in range(3):
            now = stirling.draw(np.full(n, c), np.full(n, z), d, now, key, salt)
        mean = float((p * t).sum())
        sd = math.sqrt(float((p * t * t).sum()) - mean**2)
        assert abs(now.mean() - mean) < 0.02 * mean + 5 * sd / math.sqrt(n) and abs(now.std() - sd) < 0.05 * sd + 0.03


def test_gibbs_sweeps_reach_the_posterior():
    """Many equal restaurants of two dishes against the joint distribution of their tables, summed out."""
    n, d, q = 30_000, 0.4, np.array([0.3, 0.1])
    b = hpylm.Trigrams.__new__(hpylm.Trigrams)
    b.count, b.room, b.pair, b.live = np.tile([4, 2], n), np.repeat(np.arange(n), 2), np.tile([0, 1], n), np.arange(2 * n)
    b.room_key, b.key, b.customers = tk.mix(np.arange(n).astype(np.uint64)), tk.mix(np.arange(2 * n).astype(np.uint64) + np.uint64(10**6)), np.full(n, 6)
    *_, tables = b.sweeps(q, d, np.ones(2 * n, np.int64), 6, 1)
    s, want = np.exp(stirling.table(d)), {}
    for x in range(1, 5):
        for y in range(1, 3):
            want[x, y] = s[4, x] * s[2, y] * q[0] ** x * q[1] ** y * math.prod(hpylm.THETA + d * i for i in range(x + y))
    got = collections.Counter(zip(tables[::2].tolist(), tables[1::2].tolist(), strict=True))
    for k, p in want.items():
        assert abs(got[k] / n - p / sum(want.values())) < 0.012


@pytest.mark.parametrize("order", [2, 3])
@pytest.mark.parametrize("nb,heavy", [(1, 0), (4, 0), (5, 3)])
def test_lm_probabilities_sum_to_one(monkeypatch, nb, heavy, order):
    """Every pair of words before each word, the end and a word that training has not, over buckets that share restaurants."""
    import types

    monkeypatch.setattr("pyspark.TaskContext.get", lambda: types.SimpleNamespace(partitionId=lambda: 0))
    rng = random.Random(4)
    words = [f"w{i}" for i in range(6)]
    train = [" ".join(rng.choices(words, [2.0**-i for i in range(6)], k=40)) for _ in range(60)]
    asked = [f"{u} {v} {w}".strip() for u in words for v in words for w in [*words, "unseen", ""]]
    batch = pa.RecordBatch.from_pydict({"text": train + asked, "doc_id": list(range(len(train) + len(asked))), "held": [False] * len(train) + [True] * len(asked)})
    block = next(tk.blocks(pa.array(["w0 w1"])))
    s, e, _ = tk.words(block.data, block.offsets)
    often = (tk.span_hashes(block.data, s, e) & hpylm._MASK).tolist()
    deal = hpylm.Deal(nb, dict.fromkeys(often, heavy) if heavy else {})

    def by(*tables):
        t = pa.concat_tables(tables)
        return {k: t.filter(pa.compute.equal(t["to"], k)) for k in set(t["to"].to_pylist())}

    def stage(f, left, right=None):
        none = left[next(iter(left))].slice(0, 0)
        rows = [f((pa.scalar(k),), t) if right is None else f((pa.scalar(k),), t, right.get(k, none)) for k, t in left.items()]
        return pa.concat_tables(rows)

    asks = by(pa.Table.from_batches(hpylm._asks(deal, order)(iter([batch]))))
    pairs = asks if order == 2 else by(stage(hpylm._level3_names(deal), asks))
    named = by(stage(hpylm._level2_names(deal, hpylm.ASK if order == 2 else hpylm.NAMES), pairs))
    known = [stage(hpylm._level1_names(nb), named)]
    total, n = collections.Counter(), collections.Counter()
    if order == 2:
        for i in (1, 2):
            known.append(stage(hpylm._level1_tables(nb, i), named, by(stage(hpylm._top_tables(deal, i), asks, by(*known)))))
        for k, t in asks.items():
            if k < nb:
                s = hpylm.Level2(t, by(*known)[k], deal, hpylm.ASK)
                for room, x in zip(s.b.rooms[s.b.v].tolist(), s.chances(s.b.first, hpylm._states(s, 2), 2).tolist(), strict=True):
                    total[room] += x
                    n[room] += 1
    else:
        first = stage(hpylm._level2_chances(deal, 0), pairs, by(*known))
        known.append(stage(hpylm._level3_tables(deal), asks, by(first)))
        known.append(stage(hpylm._level1_tables(nb, 1), named, by(stage(hpylm._level2_tables(deal), pairs, by(*known)))))
        chances = by(first, stage(hpylm._level2_chances(deal, 1), pairs, by(*known)))
        for r in range(nb):
            if r in asks:
                b = hpylm.Trigrams(hpylm._received(asks[r])[hpylm.ASK], deal)
                p2, d, _ = hpylm._rounds(hpylm._received(chances[r]))
                for room, x in zip(b.room.tolist(), hpylm.predictive(b, p2, d).tolist(), strict=True):
                    total[r, room] += x
                    n[r, room] += 1
    whole = [total[k] for k in total if n[k] == len(words) + 2]
    assert len(whole) == len(words) ** (order - 1) and np.allclose(whole, 1, atol=1e-6)


# 8 quality rules
def brute_quality(t):
    t = t or ""
    w = WORD.findall(t)
    at = collections.defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i : i + 8])].append(i)
    covered = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    rows = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(rows) - len(set(rows)), len(covered)


def test_quality(spark, docs, odd, none):
    for df in (docs, odd):
        got = collections.Counter(tuple(r) for r in quality.judge(quality.measures(df, "doc_id", "text")).select("doc_id", "text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect())
        want = collections.Counter()
        for r in df.collect():
            b = brute_quality(r["text"])
            want[(r["doc_id"], r["text"], *b, b[0] < 20 or 100 * b[4] > 30 * b[0])] += 1
        assert got == want
    assert quality.judge(quality.measures(none, "doc_id")).count() == 0
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality.judge(quality.measures(docs, "doc_id")).join(labels, "doc_id").filter("not base_failed").toPandas()
    assert rows[rows["quality"] == 1]["kept"].mean() > 0.97 and rows[rows["quality"] == 0]["kept"].mean() < 0.1


# 9 and 10 classifiers
def test_classifier_on_held_out_rows(spark, odd, none):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = classifier.classify(spark.read.parquet(f"{d}/documents.parquet"), labels).join(labels, "doc_id").toPandas()
    held = got[got["held_out"]]
    assert (held["predicted"] == held["quality"]).mean() > 0.95 and held["score"].between(0, 1).all()
    assert (got["held_out"] == [zlib.crc32(str(x).encode()) % 5 == 0 for x in got["doc_id"]]).all()
    assert classifier.classify(none, labels.limit(0)).count() == 0 and classifier.classify(odd, labels.limit(0)).count() == 9


def test_toxicity(spark, odd, none):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    train = labels.filter(F.crc32(F.col("doc_id").cast("string")) % 3 != 0)
    got = toxicity.classify(docs, train).withColumnRenamed("toxic", "found").join(labels, "doc_id").filter(F.crc32(F.col("doc_id").cast("string")) % 3 == 0).toPandas()
    assert (got["found"] == got["toxic"]).mean() > 0.93
    assert toxicity.classify(none, labels.limit(0)).count() == 0 and toxicity.classify(odd, labels.limit(0)).filter("toxic = 1").count() == 0


def test_log_count_ratios_and_the_optimum():
    """Ratios by hand; the dual descent's value against many random points near its weights."""
    rows = [np.array(x) for x in ([0, 1], [0], [1, 2], [2])]
    y = np.array([1, 1, 0, 0])
    r = linear.log_count_ratios(rows, y, 3)
    p, q = np.array([3, 2, 1]) / 6, np.array([1, 2, 3]) / 6
    assert np.allclose(r, np.log(p / q))
    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(0, 12, 5)) for _ in range(80)]
    y = np.array([int(0 in x or rng.random() < 0.2) for x in rows])
    scale, c = linear.log_count_ratios(rows, y, 12), 0.3
    w, _, b = linear.dual_coordinate_descent(rows, y, scale, c=c, epochs=400)
    x = np.zeros((80, 12))
    for i, row in enumerate(rows):
        x[i, row] = scale[row] / np.linalg.norm(scale[row])
    value = lambda w, b: (w @ w + b * b) / 2 + c * np.maximum(0, 1 - np.where(y > 0, 1, -1) * (x @ w + b)).sum()
    best = value(w, b)
    assert all(value(w + d[:-1], b + d[-1]) >= best - 1e-6 for d in rng.normal(0, 0.02, (300, 13)))


def test_chain_trains_out_of_fold(monkeypatch):
    """No earlier probability comes from a model that saw its row, the verdict is last and reads the others, unknown labels are left out."""
    seen = []
    real = toxicity.Link

    class Spy(real):
        def __init__(self, rows, y, earlier, calibration=None):
            super().__init__(rows, y, earlier, calibration)
            self.keys = {int(r[-1]) for r in rows}
            seen.append((self.keys, earlier.shape[1], len(y)))

        def margin(self, rows, earlier):
            assert not self.keys & {int(r[-1]) for r in rows}
            return super().margin(rows, earlier)

    monkeypatch.setattr(toxicity, "Link", Spy)
    rng = np.random.default_rng(2)
    rows = [np.array([*np.unique(rng.integers(0, 40, 6)), 1000 + i]) for i in range(90)]
    toxic = np.array([int(3 in r) for r in rows])
    good = np.array([int(5 in r) for r in rows])
    labels = np.column_stack([toxic * good, toxic * (1 - good), toxic])
    labels[:9, :2] = -1
    chain = toxicity.Chain(rows, labels)
    assert chain.names[-1] == "toxic" and [n for _, n, _ in seen] == [0] * 4 + [1] * 4 + [2] * 4
    assert [n for _, _, n in seen][3::4] == [81, 81, 90] and len(chain.links[-1].dense) == 2


# pipeline
def test_near_join_stage_with_null_and_repeated_ids(spark):
    import corpus_pipeline as cp

    base = " ".join(f"w{i}" for i in range(60))
    rows = [(None, base), (None, base), (1, base + " tail"), (None, "other words of its own here"), (2, "x y z"), (2, "p q r"), (2, "x y z"), (None, None), (3, "")]
    out = cp.near_join(spark, spark.createDataFrame([(a, b, "k") for a, b in rows], "doc_id long, text string, _row string"), SF)
    assert out.columns == ["doc_id", "text", "_row"]
    texts = collections.Counter(r["text"] for r in out.collect())
    assert sum(texts[x] for x in (base, base + " tail")) == 1 and texts["other words of its own here"] == texts["x y z"] == texts["p q r"] == texts[None] == texts[""] == 1


def test_stages_take_clashing_names(spark):
    import corpus_pipeline as cp

    text = " ".join(f"the word{i} of a thing{i}" for i in range(30))
    df = spark.createDataFrame([(i, f"{text} {i}\nline {i}", "en", "s", 9, 1, 2, 3, 4, 5) for i in range(4)], "doc_id long, text string, lang string, source string, n_chars long, copy int, n_lines int, n_removed int, _items int, kept int")
    at = df
    for _, stage in cp.STAGES[:-1]:
        at = stage(spark, at, SF)
        assert at.columns == df.columns
    assert cp.mix(spark, at, SF).columns == [*df.columns, "_copy"] and cp.mix(spark, at, SF).count() >= 1


def test_pipeline(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    at, before = docs, docs.columns
    for name, stage in cp.STAGES[:-1]:
        at = stage(spark, at, SF)
        assert at.columns == before, name
        at = spark.createDataFrame(at.toPandas(), docs.schema)
    rows = {r["doc_id"]: r["text"] for r in at.collect()}
    ok = {r["doc_id"] for r in quality.judge(quality.measures(docs, "doc_id")).filter("kept").collect()}
    assert set(rows) <= ok and 0.5 * len(ok) < len(rows)
    near = brute_near(sorted(rows.items()), nearjoin.K, nearjoin.PERCENT)
    assert all(k == v[1] for k, v in near.items())
    out = cp.run(spark, SF).toPandas()
    assert set(out["doc_id"]) <= set(rows) and out["copy"].between(1, 2).all()


def test_registered_queries(spark):
    import __spark_entry__ as e

    assert {f"op{i}_" for i in range(1, 11)} <= {m[0] for n in e.queries() if (m := re.match(r"op\d+_", n))} and "pipeline" in e.queries()
    for n in queries.QUERIES:
        assert queries.QUERIES[n](spark, SF).columns


def test_lines_of_rows_without_or_with_one_id(spark):
    """Different texts under one id (or none) are different documents; equal rows of one id are one."""
    passage = "\n".join(f"shared line {i} with the same few words" for i in range(6))
    rows = [(None, f"{passage}\nfirst of its own kind\nand one more"), (None, f"{passage}\nsecond of another kind\nand two more"), (7, f"{passage}\nthird\nand three more"), (7, f"{passage}\nthird\nand three more"), (7, f"{passage}\nfourth\nand four more")]
    out = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {(r["doc_id"], r["text"].split("\n")[-1]): r["text"].count("shared line 2") for r in out.collect()}
    assert out.count() == 5 and len(got) == 4
    assert got[None, "and one more"] == got[None, "and two more"] == 0  # the smallest id keeps it
    assert got[7, "and three more"] + got[7, "and four more"] == 1
