"""Operators that SQL does not cover, imports, and streams."""

import json
import random
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from memlake import catalog
from memlake.functions import json as js, pii, render, text as tx
from memlake.operators import analyzers, assemble, context, graph, privacy, ranking, telemetry, versions, writes
from memlake.schema import COLUMNS
from memlake.sources import imports
from memlake.streaming import feed, triggers


def test_greedy_disclosure(spark):
    rows = spark.createDataFrame([(i, float(10 - i), 30, 10) for i in range(6)], "item long, score double, full_tokens long, summary_tokens long")
    got = {r["item"]: r["level"] for r in assemble.disclosure(rows, 100).collect()}
    # 30, 60, then 90 is over 70: summary at 70, 80, 90, then over 95
    assert got == {0: "full", 1: "full", 2: "summary", 3: "summary", 4: "summary", 5: "omit"}


def test_mmr_avoids_near_copies(spark):
    pool = spark.createDataFrame([(1, [1.0, 0.0], 0.99), (2, [1.0, 0.01], 0.98), (3, [0.6, 0.8], 0.7)], "vec_id long, embedding array<double>, similarity double")
    assert [r["vec_id"] for r in ranking.mmr(pool, 2, 0.5).orderBy("place").collect()] == [1, 3]


def test_near_duplicate_rows(spark):
    df = spark.createDataFrame([(0, "a b c d e f g h"), (1, "a b c d e f g h"), (2, "x y z")], "_rank long, text string")
    assert [r["_rank"] for r in ranking.near_duplicates(df).orderBy("_rank").collect()] == [0, 2]
    obs = spark.createDataFrame([("n", 1, "h1", "a b c d e f g h i j"), ("n", 2, "h2", "a b c d e f g h i j"), ("n", 3, "h3", "k l m")], "ns string, seq long, hash string, text string")
    assert [tuple(r) for r in analyzers.near_duplicates(obs).collect()] == [("n", "h1", "h2")]


def test_near_duplicate_clusters_against_brute_force(spark):
    rng = random.Random(3)
    base = [[rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 14))] for _ in range(12)]
    rows = []
    for i in range(160):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice("abcdefghijklmnopqrstuvwxyz")
        rows.append((rng.choice("nm"), rng.randint(0, 40), f"h{i:03d}", " ".join(w)))
    rows += [("n", 50, "h900", "..."), ("n", 51, "h901", ""), ("m", 52, "h902", "-"), ("n", 53, "h903", None)]
    seeds, want = [], set()
    for ns, at, h, text in sorted((r for r in rows if r[3] is not None), key=lambda r: (r[1], r[2])):
        s = set(re.findall("[a-z]", text))
        for ns2, h2, s2 in seeds:
            if ns == ns2 and (len(s & s2) >= 0.8 * len(s | s2)):
                want.add((ns, h2, h))
                break
        else:
            seeds.append((ns, h, s))
    got = analyzers.near_duplicates(spark.createDataFrame(rows, "ns string, created_at long, hash string, text string"), 0.8)
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want) > 40
    assert analyzers.near_duplicates(spark.createDataFrame([], "ns string, created_at long, hash string, text string")).count() == 0


def test_query_expansion():
    out = ranking.expand_query("buy cars")
    assert "purchase cars" in out and out[-1] == "buy car" and len(out) <= 4


def test_cycles_have_no_level(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcd"], "node string")
    arcs = spark.createDataFrame([("a", "b"), ("c", "d"), ("d", "c")], "a string, b string")
    assert {r["node"]: r["level"] for r in graph.topological_levels(nodes, arcs).collect()} == {"a": 0, "b": 1, "c": None, "d": None}


def test_bundle_replay(spark, tmp_path):
    g = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "hash string, seq long, object string")
    log = spark.createDataFrame([(1, 10, 1, "a"), (2, 20, 1, "b"), (3, 30, 3, "a")], "op_seq long, hlc long, op int, hash string")
    writes.export(writes.bundle(g, log, 0), str(tmp_path / "b"))
    assert {r["hash"] for r in imports.bundle(spark, str(tmp_path / "b")).collect()} == {"b"}
    assert {r["hash"] for r in imports.bundle(spark, str(tmp_path / "b"), until_hlc=20).collect()} == {"a", "b"}


def test_reducers_fall_back_to_the_last_write(spark):
    w = spark.createDataFrame([("k", "n", "1", 1), ("k", "n", "x", 2), ("k", "m", "2", 1), ("k", "m", "3", 2)], "key string, field string, value string, ord long")
    assert {r["field"]: r["value"] for r in telemetry.reduce_states(w, {"n": "sum", "m": "sum"}).collect()} == {"n": "x", "m": "5"}


@pytest.mark.parametrize("text,category,want", [
    ("mail a.b@c.org now", "email", ["a.b@c.org"]), ("card 4111 1111 1111 1111 ok", "credit_card", ["4111 1111 1111 1111"]), ("card 4111 1111 1111 1112", "credit_card", []),
    ("iban GB82WEST12345698765432", "iban", ["GB82WEST12345698765432"]), ("iban GB83WEST12345698765432", "iban", []), ("at 10.0.0.255 x", "ipv4", ["10.0.0.255"]), ("v 1.2.3.4.999", "ipv4", ["1.2.3.4"]),
    ("password: hunter2", "password", ["password: hunter2"]), ("on 2024-02-30 or 2024-02-03", "date", ["2024-02-30", "2024-02-03"]),
])
def test_pii(spark, text, category, want):
    assert spark.range(1).select(pii.matches(F.lit(text), category)).first()[0] == want


def test_anonymize_is_stable_and_severe_first(spark):
    df = spark.createDataFrame([("a@b.org wrote a@b.org on 2024-05-06",)], "text string")
    p = pii.Policy({"email": "pseudonym", "date": "generalize"})
    out = df.select(pii.anonymize(F.col("text"), p, "s")).first()[0]
    a, rest = out.split(" wrote ")
    assert rest == f"{a} on 2024-05" and a.startswith("[EMAIL_")


def test_anonymize_resolves_overlaps(spark):
    def run(text, actions):
        return spark.createDataFrame([(text,)], "text string").select(pii.anonymize(F.col("text"), pii.Policy(actions), "s")).first()[0]

    assert run("card 1234567890123456 and 4111 1111 1111 1111.", {"credit_card": "redact"}) == "card 1234567890123456 and [REDACTED:CREDIT_CARD]."
    assert run("mail john.doe@example.com", {"email": "mask"}) == "mail j***.d**@e******.c**"
    assert run("on 2024-05-06", {"date": "generalize:year"}) == "on 2024" and run(None, {"date": "redact"}) == ""
    # one value inside another: each is treated as a whole
    out = run("a@b.org then xa@b.org then a@b.org", {"email": "pseudonym"}).split(" then ")
    assert out[0] == out[2] != out[1] and all(x.startswith("[EMAIL_") for x in out)
    # the severest action wins an overlap, and nothing of the loser is left half treated
    assert run("see ftp://u:p@host.org now", {"email": "pseudonym", "url_userinfo": "redact"}) == "see [REDACTED:URL_USERINFO] now"
    assert run("GB82WEST12345698765432 GB83WEST12345698765432", {"iban": "redact"}) == "[REDACTED:IBAN] GB83WEST12345698765432"
    with pytest.raises(ValueError):
        pii.Policy({"email": "shred"})


def test_signatures(spark):
    df = spark.createDataFrame([("  Failed  at /tmp/a1 after 35 ms",)], "c string")
    assert df.select(tx.normalize_signature(F.col("c"))).first()[0] == "failed at <path> after # ms"


def test_templates():
    assert render.template("{{#each tags}}<{{this}}>{{/each}}{{#if no}}y{{else}}n{{/if}}{{x | default('z')}}", {"tags": ["a", "b"]}) == "<a><b>nz"
    assert render.template("{{t | date('%Y-%m-%d')}} {{r | humanize}}", {"t": 0, "r": "mg:is_a"}) == "1970-01-01 is a"


def test_imports(spark, tmp_path):
    put = lambda name, text: (tmp_path / name).write_text(text) and str(tmp_path / name)
    m = imports.read(spark, "mem0", put("m.json", json.dumps({"results": [{"memory": "likes tea", "user_id": "u", "created_at": "2024-01-01T00:00:00Z"}]}))).first()
    assert (m["subject"], m["object"], m["created_at"]) == ("u", "likes tea", 1704067200000)
    e = imports.read(spark, "langgraph", put("l.jsonl", '{"thread_id": "t", "role": "user", "content": "hi", "ts": 5}\n')).first()
    assert (e["session_id"], e["role"], e["content"], e["created_at"]) == ("t", "user", "hi", 5)
    t = imports.read(spark, "tool-log", put("t.jsonl", '{"tool": "x", "ok": false, "error": "bad", "ts": 7}\n')).first()
    assert t["attrs"]["is_error"] == "true" and t["attrs"]["tool_name"] == "x"
    n = imports.read(spark, "basic-memory", put("note.md", "# T\n- knows [[bob]]\n- [fact] likes tea\n")).orderBy("seq").collect()
    assert [(r["subject"], r["relation"], r["object"]) for r in n] == [("note", "knows", "bob"), ("note", "fact", "likes tea")]
    z = imports.read(spark, "zep", put("z.jsonl", '{"source": "a", "name": "KNOWS", "target": "b", "valid_at": "2024-01-01T00:00:00Z"}\n')).first()
    assert (z["relation"], z["valid_from"]) == ("knows", 1704067200000)


def test_change_stream_and_trigger(spark, tmp_path):
    log, grains = str(tmp_path / "log"), spark.createDataFrame([("a", "x"), ("b", "y")], "hash string, object string")
    schema = "op_seq long, hlc long, op int, hash string"
    spark.createDataFrame([(1, 1, 1, "a"), (2, 2, 3, "a")], schema).write.mode("append").parquet(log)
    got = []
    hook = lambda df, n: got.extend(r["hash"] for r in df.collect())
    run = lambda: feed.run_available(feed.memory_trigger(feed.change_stream(spark, log, schema), grains, F.lit(True)), str(tmp_path / "cp"), hook)
    run()
    spark.createDataFrame([(3, 3, 1, "b")], schema).write.mode("append").parquet(log)
    run()
    assert got == ["a", "b"] and feed.seed_cursor(spark.read.parquet(log)) == 3


def test_composite_windows_begin_again(spark):
    rows = [("k", "a", 0), ("k", "a", 1000), ("k", "b", 1050), ("j", "b", 5), ("j", "x", 6), ("j", "a", 7), ("i", "a", 0), ("i", "b", 1), ("i", "x", 2), (None, "a", 0), ("h", "z", 1)]
    df = spark.createDataFrame(rows, "key string, alias string, ts long")
    got = {tuple(r) for r in triggers.composite(df, ("and", "a", "b"), 100, {"a", "b", "x"}).select("key", "started", "last_ts").collect()}
    assert got == {("k", 1000, 1050), ("j", 5, 7), ("i", 0, 1)}
    # a key's gate may hold again in its next window, and once in each
    again = spark.createDataFrame([("k", a, t) for t, a in ((0, "a"), (1, "b"), (2, "a"), (3, "b"), (500, "b"), (510, "a"))], "key string, alias string, ts long")
    assert sorted(r["started"] for r in triggers.composite(again, ("and", "a", "b"), 100, {"a", "b"}).collect()) == [0, 500]
    assert triggers.composite(df, ("and", "a", ("not", "x")), 100, {"a", "x"}).filter("key = 'j'").count() == 0


def test_composite_trigger_stream(spark, tmp_path):
    src, rows = str(tmp_path / "ev"), []
    spark.createDataFrame([("k", "a", 10), ("k", "b", 20), ("j", "a", 5), ("j", "b", 9000), (None, "a", 1)], "key string, alias string, ts long").write.parquet(src)
    stream = spark.readStream.schema("key string, alias string, ts long").parquet(src)
    out = triggers.composite_stream(stream, ("and", "a", "b"), 1000, {"a", "b"})
    feed.run_available(out, str(tmp_path / "cp"), lambda df, n: rows.extend(tuple(r) for r in df.collect()))
    assert rows == [("k", 10, "a,b", 20)]
    with pytest.raises(ValueError):
        triggers.composite(stream, ("and", "a", "z"), 1000, {"a", "b"})


def test_governance_and_pairs(spark):
    recs = spark.createDataFrame([("r1",), ("r2",)], "dedup_key string")
    audit = spark.createDataFrame([("r1", "approve", 1, 1), ("r1", "apply", 2, 2)], "dedup_key string, action string, at long, seq long")
    assert {r["dedup_key"]: r["status"] for r in analyzers.governance_status(recs, audit).collect()} == {"r1": "apply", "r2": "pending"}
    t = versions.tips(spark.createDataFrame([("a", None, "s", "r"), ("b", "a", "s", "r")], "hash string, supersedes string, subject string, relation string"))
    assert [r["hash"] for r in t.collect()] == ["b"]


def test_json_conditions(spark):
    df = spark.createDataFrame([('{"a": {"b": "x"}, "n": 0, "t": true}',), (None,)], "p string")
    conditions = ['a.b == "x"', 'a.b != "x"', "a.b exists", "n", "!n", "t", "none exists", "!none"]
    got = [list(r) for r in df.select(*[js.edge_condition(c, F.col("p")).alias(f"c{i}") for i, c in enumerate(conditions)]).collect()]
    assert got == [[True, False, True, False, True, True, False, True], [False, True, False, False, True, False, False, True]]


def test_hmac_and_rehydration(spark):
    import hashlib
    import hmac

    assert spark.range(1).select(tx.hmac_sha256(F.lit("héllo"), b"key")).first()[0] == hmac.new(b"key", "héllo".encode(), hashlib.sha256).hexdigest()
    rows = spark.createDataFrame([(1, "ask a@b.org or c@d.org"), (2, "none")], "id long, text string")
    hidden = rows.select("id", pii.anonymize(F.col("text"), pii.Policy({"email": "pseudonym"}), "s").alias("text"))
    tokens = spark.createDataFrame([("a@b.org",), ("c@d.org",)], "value string").select(pii.pseudonym(F.col("value"), "EMAIL", "s").alias("token"), "value")
    assert hidden.filter("text like '%@%'").count() == 0
    assert {tuple(r) for r in privacy.rehydrate(hidden, tokens, "id").collect()} == {tuple(r) for r in rows.collect()}


def test_context_modes():
    assert context.mode("when did it start?", 3) == "timeline" and context.mode("who is it?", 3, sessions=2) == "census" and context.mode("who?", 1) == "single"


def test_next_due():
    assert triggers.next_due("*/15 * * * *", None, 0, 1_706_745_600_000) == 1_706_745_600_000 + 900_000
    assert triggers.next_due(None, 60_000, 100_000, 0) == 160_000
    assert triggers.next_due(None, None, 0, 50, once_ms=51) == 51 and triggers.next_due(None, None, 0, 51, once_ms=51) is None


@pytest.mark.parametrize("cron,after,want", [
    ("0 0 1 * *", "2024-02-01T00:00", "2024-03-01T00:00"), ("0 12 29 2 *", "2024-03-01T00:00", "2028-02-29T12:00"), ("30 8 * * 7", "2024-02-01T00:00", "2024-02-04T08:30"),
    ("30 8 * * SUN", "2024-02-04T08:30", "2024-02-11T08:30"), ("0 0 13 * 5", "2024-02-01T00:00", "2024-02-02T00:00"), ("0 0 13 * 5", "2024-02-10T00:00", "2024-02-13T00:00"),
    ("5 4 31 JAN-MAR *", "2024-02-01T00:00", "2024-03-31T04:05"), ("0 0 30 2 *", "2024-02-01T00:00", None), ("59 23 31 12 *", "2024-12-31T23:59", "2025-12-31T23:59"),
])
def test_cron(spark, cron, after, want):
    ms = lambda x: int(datetime.fromisoformat(x + "+00:00").timestamp() * 1000)
    got = triggers.next_due(cron, None, 0, ms(after))
    assert got == (None if want is None else ms(want))
    if want:
        assert spark.range(1).select(triggers.cron_matches(cron, F.timestamp_millis(F.lit(got)))).first()[0]


def test_polling_source_seeds_its_cursor_first(spark, tmp_path):
    from memlake.sources.connector import PollingReader, PollingSource

    script = tmp_path / "feed.py"
    script.write_text('import json, sys\nc = int(sys.argv[1] or 5)\nprint(json.dumps({"items": [{"id": c + 1, "payload": {"k": c}}] if sys.argv[1] else [{"id": 1}], "cursor": c + 1}))\n')
    r = PollingReader(f"python {script}")
    start = r.initialOffset()
    items, end = r.read(start)
    assert start == {"cursor": "6"} and list(items) == [("7", '{"k": 6}')] and end == {"cursor": "7"}
    spark.dataSource.register(PollingSource)
    assert spark.readStream.format("memlake_poll").option("command", f"python {script}").load().columns == ["id", "payload"]


def test_rerank_seam(spark):
    pool = spark.createDataFrame([(1, "aa"), (2, "a")], "seq long, text string")
    out = ranking.rerank(pool, "q", lambda q, texts: [-len(t) for t in texts])
    assert [r["seq"] for r in out.orderBy("_rank").collect()] == [2, 1]


def test_set_operations_are_not_cut(spark, monkeypatch):
    """Operands of 1600 and 2200 rows, the newest 1000 of each far apart."""
    own = {"seq": F.col("id"), "hash": F.col("id").cast("string"), "grain_type": F.lit("fact"), "ns": F.when(F.col("id") >= 1400, "geo.supply").otherwise("geo"), "object": F.when(F.col("id") < 1600, "nation:3").otherwise("nation:4")}
    grains = spark.range(3600).select(*[own.get(c, F.lit(None)).cast(t).alias(c) for c, t in COLUMNS.items()])
    monkeypatch.setattr(catalog.T, "grains", lambda spark, d: grains)
    rows = lambda name: sorted(r["seq"] for r in catalog.QUERIES[name](spark, "").collect())
    assert rows("set_union") == list(range(3600))
    assert rows("set_intersect") == list(range(1400, 1600))
    assert rows("set_except") == list(range(1400))


def test_supersession_pairs_with_keys_over_a_million(spark, tmp_path):
    """Against the query's SQL, where orders of one day have keys on both sides of a multiple of a million."""
    import datetime

    import duckdb

    import __spark_entry__ as entry

    day = datetime.datetime(1996, 5, 1)
    rows = [(999_999, 7, "O", 1.0, day, "x"), (1_000_001, 7, "O", 1.0, day, "x"), (2_000_003, 7, "O", 1.0, day, "x"), (5, 8, "O", 1.0, day, "x"), (6, 8, "O", 1.0, day, "x"), (7, 9, "O", 1.0, day, "x")]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.sql(f"create view orders as select * from '{tmp_path}/orders.parquet/*.parquet'")
    for name in ("customer", "nation", "supplier", "conversations", "events"):
        con.sql(f"create view {name} as select * from '/root/testdata/sf0.001/{name}.parquet'")
    want = con.sql(entry.oracle_sql()["supersession_pairs"]).fetchall()
    got = entry.queries()["supersession_pairs"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) == 2
    # the operator's own order is that of (created_at, seq)
    from memlake.sources import tables as T

    by = {r["subject"]: (r["oldest"], r["newest"]) for r in versions.supersession_pairs(T.order_versions(spark, str(tmp_path))).collect()}
    assert by["customer:7"] == ("order:999999", "order:2000003")


def test_candidate_sets_are_verified_in_parts():
    """A task gets each set once, whatever the number of its pairs; the threshold itself is reached."""
    import pyarrow as pa

    sets = {b"a": list(range(10)), b"b": list(range(9)), b"c": list(range(8)), b"d": list(range(5, 15))}
    left = pa.table({"set": list(sets), "tokens": pa.array(list(sets.values()), pa.list_(pa.int64()))})
    pairs = [(x, y) for x in sorted(sets) for y in sorted(sets) if x < y]
    right = pa.table({"ns": ["n"] * len(pairs), "x": [p[0] for p in pairs], "y": [p[1] for p in pairs]})
    got = analyzers._reach(0.8)(left, right).to_pylist()
    want = [p for p in pairs if len({*sets[p[0]]} & {*sets[p[1]]}) >= 0.8 * len({*sets[p[0]]} | {*sets[p[1]]})]
    assert [(r["x"], r["y"]) for r in got] == want == [(b"a", b"b"), (b"a", b"c"), (b"b", b"c")]
