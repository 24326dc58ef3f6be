"""A memory: grains and the query language over them.

cal() parses a statement and binds it to one lazy DataFrame (or a dict of them
for BATCH); Catalyst does the rest.  Reads start no job, but for a template or
an ASSEMBLE whose pinned sources have to be weighed.  Writes replace the
memory's grains by a new plan over the old ones.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, functions as F
from pyspark.sql import Window as W

from .functions import render
from .functions.text import relative_label
from .operators import assemble, graph, predicates, privacy, ranking, scans, setops, stages, versions, writes
from .operators.telemetry import store_stats
from .plans import ast as A
from .plans.lexer import QueryError
from .plans.parser import MAX_LIMIT, parse
from .schema import COLUMNS, TYPES
from .sources.tables import content_hash

DEFAULT_LIMIT = 50
LET_CAP = 1000


class Memory:
    def __init__(self, grains: DataFrame, ns: str = "shared", now_ms: int | None = None, user: str | None = None, mounts: dict[str, DataFrame] | None = None, default_limit: int = DEFAULT_LIMIT,
                 vectors: DataFrame | None = None, embed: Callable[[str], list[float]] | None = None, scorer: Callable[[str, list[str]], list[float]] | None = None):
        """vectors (seq, embedding) with embed give recall its vector leg; scorer of (query, texts) its reranking."""
        self.vectors, self.embed, self.scorer = vectors, embed, scorer
        self.grains, self.spark, self.ns, self.user = grains, grains.sparkSession, ns, user
        self.now_ms = int(time.time() * 1000) if now_ms is None else now_ms
        self.mounts, self.default_limit = mounts or {}, default_limit
        self.queries: dict[str, A.DefineQuery] = {}
        self.templates: dict[str, A.DefineTemplate] = {}
        self.grants: list[tuple[str, str, str, bool]] = []
        self.audit: list[dict] = []
        self.warnings: list[str] = []
        self.seq = 1 << 50

    # entry
    def cal(self, text: str, **bound) -> DataFrame | dict[str, DataFrame]:
        self.warnings = []
        return self.run(parse(text), dict(bound))

    def run(self, q: A.Query, bound: dict | None = None):
        bound = dict(bound or {})
        for let in q.lets:
            rows = self.run(let.recall, bound)
            column = {"subjects": "subject", "objects": "object", "hashes": "hash"}[let.extractor]
            bound[let.name] = rows.filter(F.col(column).isNotNull()).orderBy("_rank").limit(LET_CAP).select(F.col(column).alias("value")).distinct()
        s = q.statement
        if isinstance(s, A.Recall):
            out = self.recall(s, q, bound)
        elif isinstance(s, A.SetOp):
            out = setops.combine(s.op, [self.recall(r, A.Query(r, options=q.options), bound) for r in s.operands])
            if q.where_after is not None:
                out = self.where(out, q.where_after, None, bound)
            out = stages.apply(out, q.stages, MAX_LIMIT)
        else:
            out = getattr(self, "on_" + type(s).__name__)(s, q, bound)
            if isinstance(out, DataFrame) and q.stages:
                if "_rank" not in out.columns:
                    self.warnings.append("CAL-W016: a pipeline stage can not act on this result")
                else:
                    out = stages.apply(out, q.stages, MAX_LIMIT)
        if q.formats and isinstance(out, DataFrame) and "grain_type" in out.columns:
            level = (q.options.get("progressive_disclosure") or ["full"])[0]
            done = {alias or f: self.render(out, f, level) for f, alias in q.formats}
            return next(iter(done.values())) if len(done) == 1 else done
        return out

    # recall
    def where(self, df: DataFrame, cond, grain_type: str | None, bound: dict) -> DataFrame:
        """Filters; membership in a bound set is a semi-join (anti-join when negated)."""
        joins, rest = predicates.semi_join_parts(cond)
        for j in joins:
            rows = bound.get(j.values.name)
            if rows is None:
                raise QueryError("CAL-E008", f"${j.values.name} is not bound")
            if not isinstance(rows, DataFrame):
                df = df.filter(predicates.compile_condition(j, grain_type, bound))
                continue
            predicates.check_field(j.field, grain_type)
            keys = rows.select(F.col("value").alias("_in"))
            df = df.join(keys, predicates.field(j.field) == F.col("_in"), "left_anti" if j.negated else "left_semi")
        return df if rest is None else df.filter(predicates.compile_condition(rest, grain_type, {k: v for k, v in bound.items() if not isinstance(v, DataFrame)}))

    def source(self, r: A.Recall) -> DataFrame:
        """The session's grains, or a mount's when a namespace names one."""
        ns = _namespace(r.where)
        if ns and "." in ns and ns.split(".")[0] in self.mounts:
            alias, inner = ns.split(".", 1)
            return self.mounts[alias].withColumn("ns", F.concat(F.lit(alias + "."), "ns")) if inner else self.mounts[alias]
        return self.grains

    def matching(self, r: A.Recall, options: dict, bound: dict) -> DataFrame:
        """All grains that the statement's filters select, before order and limit."""
        if r.grain_type is None and r.about is None and not _anchored(r.where):
            raise QueryError("VAL-E001", "an untyped RECALL needs a subject, a session or free text")
        df = self.source(r)
        if r.grain_type is not None:
            df = df.filter(F.col("grain_type") == r.grain_type)
        if "superseded" not in options:
            df = scans.live(df)
        if r.where is not None:
            df = self.where(df, r.where, r.grain_type, bound)
        if r.mine:
            df = df.filter(F.col("user_id").eqNullSafe(F.lit(self.user)) & F.col("user_id").isNotNull())
        if r.since is not None:
            df = df.filter(F.col("created_at") >= predicates.moment(r.since, self.now_ms))
        if r.until is not None:
            df = df.filter(F.col("created_at") <= predicates.moment(r.until, self.now_ms, end=True))
        if r.contradictions:
            df = versions.contested(self.grains, df)
            if r.contradictions_of is not None:
                scope = self.run(r.contradictions_of, bound).select(*versions.KEY).distinct()
                df = df.join(scope, list(versions.KEY), "left_semi")
        return df

    def recall(self, r: A.Recall, q: A.Query, bound: dict) -> DataFrame:
        options = q.options
        df = self.matching(r, options, bound)
        if "conflict_resolution" in options:
            df = versions.conflict_resolution(df)
        k = r.recent or r.limit or self.default_limit
        order = next((s for s in q.stages if s.name == "order"), None)
        if any(s.name == "count" for s in q.stages) and r.limit is None and r.recent is None and r.about is None:
            return stages.apply(df.withColumn("_rank", F.lit(0).cast("long")), [s for s in q.stages if s.name in ("count",)], MAX_LIMIT)
        if r.about is not None:
            out = self.ranked(df, r, k, options)
        elif order is not None and q.stages[0] is order and "dedup" not in options:
            out = df.withColumns({"_rank": -F.col("seq"), "score": F.lit(1.0)})
            return self.decorated(stages.apply(out, q.stages, k), options)
        else:
            dedup = (options.get("dedup") or [None])[0]
            if dedup:
                df = ranking.dedup_by(df.withColumn("_rank", -F.col("seq")), dedup).drop("_rank")
            top = df.orderBy(F.desc("seq")).limit(k)
            out = top.withColumn("_rank", F.row_number().over(W.orderBy(F.desc("seq"))).cast("long")).withColumn("score", F.lit(1.0))
        if "recency_weight" in options:
            out = ranking.recency_weight(out.withColumn("_rank", F.col("_rank") - 1), float(options["recency_weight"][0]), self.now_ms, k)
            out = out.withColumn("_rank", F.row_number().over(W.orderBy(F.desc("score"), F.desc("seq"))).cast("long"))
        if "min_score" in options:
            out = out.filter(F.col("score") >= float(options["min_score"][0]))
        if "multi_hop" in options:
            hops = int(float((options["multi_hop"] or [1])[0]))
            more = ranking.multi_hop(self.grains, out, hops).join(self.grains, ["hash", "seq"])
            more = more.withColumns({"score": F.lit(0.0), "_rank": (F.lit(1 << 20) * F.col("hop") + F.row_number().over(W.partitionBy("hop").orderBy(F.desc("seq")))).cast("long")})
            out = out.unionByName(more.drop("hop"), allowMissingColumns=True).orderBy("_rank").limit(k)
        return self.decorated(stages.apply(out, q.stages, k), options)

    def ranked(self, df: DataFrame, r: A.Recall, k: int, options: dict) -> DataFrame:
        """Text, subject and vector legs, fused by rank where there are several; a wider pool is reranked, or else diversified."""
        text, semantic = r.about, self.embed is not None and self.vectors is not None
        again, spread = "rerank" in options and self.scorer is not None, "diversity" in options and semantic
        wide = max(k, ranking.POOL) if again or spread else 2 * k
        legs = [ranking.bm25(df, text, wide)]
        if "query_expansion" in options:
            legs += [ranking.bm25(df, v, wide) for v in ranking.expand_query(text)]
        if _subject(r.where):
            legs.append(df.orderBy(F.desc("seq")).limit(wide).select("seq", F.col("seq").cast("double").alias("score")))
        if semantic:
            like = self.embed(text)
            vectors = self.vectors.join(df.select("seq"), "seq", "left_semi")
            legs.append(ranking.nearest(vectors, like, wide, "seq").withColumnRenamed("similarity", "score"))
        scored = legs[0] if len(legs) == 1 else ranking.rrf(legs, wide)
        place = F.row_number().over(W.orderBy(F.desc("score"), F.desc("seq"))).cast("long")
        out = df.join(scored, "seq").withColumn("_rank", place)
        if again:
            out = ranking.rerank(out, text, self.scorer)
        elif spread:
            out = ranking.diversified(out, self.vectors, like, k, float((options["diversity"] or [0.5])[0]))
        out = out.filter(F.col("_rank") <= k)
        dedup = (options.get("dedup") or [None])[0]
        return ranking.dedup_by(out, dedup) if dedup else out

    def decorated(self, out: DataFrame, options: dict) -> DataFrame:
        if "contradiction_detection" in options and "hash" in out.columns:
            forks = versions.contested(self.grains).select("hash", "contested_by")
            out = out.join(forks, "hash", "left")
        if "annotate_relative_time" in options and "created_at" in out.columns:
            out = out.withColumn("relative_time", relative_label(F.col("created_at"), F.lit(self.now_ms)))
        if "explanation" in options and "score" in out.columns:
            how = F.when(F.col("score") == 1.0, F.lit("matched its filters")).otherwise(F.lit("matched the free text"))
            out = out.withColumn("explanation", how)
        if "include_sources" in options and "derived_from" in out.columns:
            parents = self.grains.select(F.col("hash").alias("derived_from"), F.col("text").alias("source_text"))
            out = out.join(parents, "derived_from", "left")
        return out

    def render(self, df: DataFrame, fmt: str, level: str = "full"):
        if fmt.startswith(("template:", "inline:")):
            kind, _, body = fmt.partition(":")
            sections = {"element": body} if kind == "inline" else self.template_sections(body)
            rows = [r.asDict() for r in df.orderBy("_rank").limit(MAX_LIMIT).collect()]
            parts = [render.template(sections["header"], {"count": len(rows)})] if "header" in sections else []
            parts += [render.template(sections["element"], {**r, **(r.get("attrs") or {})}) for r in rows]
            parts += [render.template(sections["footer"], {"count": len(rows)})] if "footer" in sections else []
            return self.spark.createDataFrame([("\n".join(parts),)], "text string")
        if fmt in ("yaml", "toon"):
            fields = ["grain_type", "subject", "relation", "object", "content", "confidence"]
            rows = [r.asDict() for r in df.orderBy("_rank").limit(MAX_LIMIT).select(*[f for f in fields if f in df.columns]).collect()]
            return self.spark.createDataFrame([(render.yaml(rows) if fmt == "yaml" else render.toon(rows, fields),)], "text string")
        return render.block(df, fmt, level)

    def template_sections(self, name: str) -> dict[str, str]:
        t = self.templates.get(name)
        if t is None:
            raise QueryError("CAL-E041", f"no template is called {name}")
        base = {"element": "- {{subject}} {{relation | humanize}} {{object}}{{content}}"}
        if t.extends and t.extends in self.templates:
            base = self.template_sections(t.extends)
        return base | t.sections

    # other reads
    def on_Exists(self, s: A.Exists, q, bound) -> DataFrame:
        rows = self.matching(s.recall, q.options, bound).limit(1)
        return rows.agg((F.count("*") > 0).alias("exists"))

    def on_History(self, s: A.History, q, bound) -> DataFrame:
        if s.diff is not None:
            fields = [c for c in COLUMNS if c not in ("attrs", "tags", "seq")]
            return versions.diff(scans.by_hash(self.grains, s.hash), scans.by_hash(self.grains, s.diff), fields)
        if s.hash is not None:
            starts = scans.by_hash(self.grains, s.hash).select("hash")
            chain = versions.history(self.grains, starts)
            return chain.join(self.grains, "hash").withColumn("_rank", F.col("depth").cast("long")).withColumn("score", F.lit(1.0))
        found = self.where(scans.live(self.grains), s.where, None, bound).select(*versions.KEY).distinct()
        rows = versions.ordered_history(self.grains.join(found, list(versions.KEY), "left_semi"))
        return rows.withColumn("_rank", F.col("version").cast("long")).withColumn("score", F.lit(1.0))

    def on_EntityAt(self, s: A.EntityAt, q, bound) -> DataFrame:
        key = self.grains.filter((F.col("subject") == s.subject) & (F.col("relation") == s.relation))
        return (versions.as_of_world if s.axis == "world" else versions.as_of_knowledge)(key, s.at)

    def on_RunTrace(self, s: A.RunTrace, q, bound) -> DataFrame:
        return graph.run_trace(self.grains, s.run_id, s.limit or 1024)

    def on_RunsTouching(self, s: A.RunsTouching, q, bound) -> DataFrame:
        return graph.runs_touching(self.grains, s.hash, s.depth)

    def on_DerivedFrom(self, s: A.DerivedFrom, q, bound) -> DataFrame:
        return graph.derived_from(self.grains, s.hash)

    def on_ShowForks(self, s, q, bound) -> DataFrame:
        return versions.open_forks(self.grains)

    def on_Related(self, s: A.Related, q, bound) -> DataFrame:
        return graph.related(self.grains, s.start, s.via, s.direction, s.depth, s.limit)

    def on_Novelty(self, s: A.Novelty, q, bound) -> DataFrame:
        df = scans.live(self.grains)
        for c, v in (("subject", s.subject), ("relation", s.relation)):
            df = df if v is None else df.filter(F.col(c) == v)
        return df.join(ranking.bm25(df, s.text, s.limit), "seq").select("hash", "text", "score")

    def on_ReportSubject(self, s: A.ReportSubject, q, bound) -> DataFrame:
        return privacy.report_subject(self.grains, s.subject, s.text_mentions)

    def on_Coalesce(self, s: A.Coalesce, q, bound) -> DataFrame:
        return setops.coalesce([self.run(b, bound) for b in s.branches])

    def on_Batch(self, s: A.Batch, q, bound) -> dict[str, DataFrame]:
        return {k: self.run(v, bound) for k, v in s.entries.items()}

    def on_Assemble(self, s: A.Assemble, q, bound) -> DataFrame:
        budget, labels, parts = s.budget or assemble.DEFAULT_BUDGET, [x.label for x in s.sources], []
        relevant: list[str] = []  # sources whose scores say how well a row fits
        wanted = [c for c in (*COLUMNS, "score", "_rank")]
        for i, x in enumerate(s.sources):
            if x.literal is not None:
                one = self.spark.range(1).select(F.lit("").alias("hash"), F.lit("literal").alias("grain_type"), F.lit(x.literal).alias("content"), F.lit(x.literal).alias("text"), F.lit(1.0).alias("score"), F.lit(0).cast("long").alias("_rank"))
            elif x.hashes is not None:
                one = scans.by_hash(self.grains, *x.hashes).withColumns({"score": F.lit(1.0), "_rank": F.col("seq")})
            else:
                one = self.run(x.query, bound)
            one = one.select(*[F.col(c) if c in one.columns else F.lit(None).cast(COLUMNS.get(c, "double")).alias(c) for c in wanted])
            parts.append(one.withColumns({"source": F.lit(x.label), "_source_no": F.lit(i)}))
            if x.query is not None and getattr(x.query.statement, "about", None) is not None:
                relevant.append(x.label)
        rows = reduce(lambda a, b: a.unionByName(b), parts)
        by = (q.options.get("dedup") or [None])[0] if "dedup" in q.options else None
        first = sorted(labels, key=lambda x: -s.priority.get(x, 0.0)) if by else labels
        rows = assemble.cap(assemble.dedup_sources(rows, by, first))
        if "dedup" in q.options and by is None:
            rows = ranking.near_duplicates(rows.withColumn("_rank", F.col("_rank") + F.col("_source_no").cast("long") * (1 << 40)))
        rows = rows.withColumn("tokens", F.lit(1).cast("long") if s.unit == "grains" else assemble.tokens_of(rows))
        pins = {x.label for x in s.sources if x.pin}
        cost = {}
        if pins:
            got = {r["source"]: int(r["t"]) for r in rows.filter(F.col("source").isin(list(pins))).groupBy("source").agg(F.sum("tokens").alias("t")).collect()}
            cost = {p: got.get(p, 0) for p in pins}
        alloc = assemble.allocate(labels, s.priority, budget, cost)
        out = assemble.budget_prefix(rows, alloc, pins)
        out = out.withColumn("allocated", F.element_at(F.create_map(*[x for k, v in alloc.items() for x in (F.lit(k), F.lit(v))]), F.col("source")))
        out = out.withColumn("_rank", F.col("_source_no").cast("long") * (1 << 41) + F.col("_rank"))
        if "conflict_resolution" in q.options:
            out = versions.conflict_resolution(out)
        if "min_score" in q.options:
            out = out.filter(~F.col("source").isin(relevant) | (F.col("score") >= float(q.options["min_score"][0])))
        if "diversity" in q.options:
            out = out.withColumn("_rank", F.row_number().over(W.orderBy(F.desc("score"), "_rank")).cast("long"))  # CAP rows at most
        return out

    def on_Explain(self, s: A.Explain, q, bound) -> DataFrame:
        inner = s.query.statement
        routing = "hybrid_rrf" if isinstance(inner, A.Recall) and inner.about and "query_expansion" in s.query.options else "bm25" if isinstance(inner, A.Recall) and inner.about else "structural"
        rows = self.run(s.query, bound)
        plan = rows._jdf.queryExecution().optimizedPlan().toString() if isinstance(rows, DataFrame) else ""
        return self.spark.createDataFrame([(type(inner).__name__.lower(), routing, plan)], "statement string, routing string, plan string")

    def on_Describe(self, s: A.Describe, q, bound) -> DataFrame:
        if s.what in ("schema", "types"):
            return self.spark.createDataFrame([(t.name, t.plural, list(t.required), list(t.fields)) for t in TYPES.values()], "name string, plural string, required array<string>, fields array<string>")
        if s.what == "fields":
            one = TYPES.get(s.argument or "fact") or next(t for t in TYPES.values() if t.plural == s.argument)
            return self.spark.createDataFrame([(f,) for f in one.fields], "field string")
        if s.what == "stats":
            return store_stats(self.grains)
        if s.what == "integrity":
            return versions.verify(self.grains, content_hash(*[F.col(c) for c in ("grain_type", "ns", "subject", "relation", "object", "content", "created_at", "seq")]))
        if s.what == "queries":
            return self.spark.createDataFrame([(n, v.params, v.body) for n, v in self.queries.items()], "name string, params array<string>, body string")
        if s.what == "templates":
            return self.spark.createDataFrame([(n, v.extends) for n, v in self.templates.items()], "name string, extends string")
        if s.what in ("capabilities", "server", "grammar", "principal", "policy", "loop", "analyzers", "outcomes"):
            return self.spark.createDataFrame([("statements", str(len([m for m in dir(self) if m.startswith("on_")]) + 2)), ("limit", str(MAX_LIMIT)), ("principal", str(self.user))], "key string, value string")
        one = TYPES.get(s.what) or next((t for t in TYPES.values() if t.plural == s.what), None)
        if one is None:
            raise QueryError("CAL-E002", f"nothing to describe is called {s.what}")
        return self.spark.createDataFrame([(one.name, list(one.required), list(one.fields))], "name string, required array<string>, fields array<string>")

    # writes
    def _next(self) -> int:
        self.seq += 1
        return self.seq

    def _audit(self, verb: str, target: str, reason: str | None) -> None:
        self.audit.append({"verb": verb, "target": target, "reason": reason, "principal": self.user})
        note = writes.row(self.spark, "observation", {"namespace": "agent:authz", "content": f"{verb} {target}: {reason}", "observer_id": str(self.user), "observer_type": "audit"}, "agent:authz", self._next(), self.now_ms)
        self.grains = self.grains.unionByName(note)

    def on_Add(self, s: A.Add, q, bound) -> DataFrame:
        writes.validate(s.grain_type, s.fields)
        new = writes.row(self.spark, s.grain_type, s.fields, s.fields.get("namespace", self.ns), self._next(), self.now_ms)
        if "auto_relate" in s.options:
            self.warnings.append("CAL-W013: auto_relate infers nothing")
        self.grains = writes.add(self.grains, new)
        return new

    def on_AddWorkflow(self, s: A.AddWorkflow, q, bound) -> DataFrame:
        nodes = sorted({n for e in s.edges for n in e})
        fields = {"name": s.name, "nodes": ",".join(nodes), "edges": ",".join(f"{a}->{b}" for a, b in s.edges), "bindings": ",".join(f"{k}={v}" for k, v in s.bindings.items())}
        new = writes.row(self.spark, "workflow", fields, self.ns, self._next(), self.now_ms)
        self.grains = writes.add(self.grains, new) if s.supersedes is None else writes.supersede(self.grains, s.supersedes, new)
        return new

    on_SupersedeWorkflow = on_AddWorkflow

    def on_Supersede(self, s: A.Supersede, q, bound) -> DataFrame:
        old = scans.by_hash(self.grains, s.hash)
        changed = {("ns" if k == "namespace" else k): v for k, v in s.fields.items()}
        own = {k: F.lit(v).cast(COLUMNS[k]) for k, v in changed.items() if k in COLUMNS}
        extra = [F.lit(x) for k, v in changed.items() if k not in COLUMNS for x in (k, str(v))]
        new = old.withColumns({**own, "seq": F.lit(self._next()), "created_at": F.lit(self.now_ms), "superseded_by": F.lit(None).cast("string"), "text": F.lit(None).cast("string")})
        if extra:
            new = new.withColumn("attrs", F.map_concat(F.coalesce("attrs", F.create_map().cast("map<string,string>")), F.create_map(*extra)))
        from .sources.tables import canonical

        new = canonical(new.drop("hash"))
        self.grains = writes.supersede(self.grains, s.hash, new)
        return new

    def on_Accumulate(self, s: A.Accumulate, q, bound) -> DataFrame:
        tip = self.where(scans.live(self.grains), s.where, None, bound).orderBy(F.desc("seq")).limit(1)
        attrs = F.coalesce("attrs", F.create_map().cast("map<string,string>"))
        for f, d in s.adds.items():
            now = F.coalesce(F.col("attrs")[f].try_cast("double"), F.lit(0.0)) + float(d)
            attrs = _with_key(attrs, f, now.cast("string"))
        for f, v in s.sets.items():
            attrs = _with_key(attrs, f, F.lit(str(v)))
        from .sources.tables import canonical

        new = canonical(tip.withColumns({"attrs": attrs, "supersedes": F.col("hash"), "derived_from": F.col("hash"), "seq": F.lit(self._next()), "created_at": F.lit(self.now_ms)}).drop("hash"))
        gone = new.select(F.col("supersedes").alias("_p"), F.col("hash").alias("_by"))
        old = self.grains.join(F.broadcast(gone), F.col("hash") == F.col("_p"), "left")
        self.grains = old.withColumn("superseded_by", F.coalesce("superseded_by", "_by")).drop("_p", "_by").unionByName(new)
        return new

    def on_Merge(self, s: A.Merge, q, bound) -> DataFrame:
        parents = versions.merge_heads(self.grains, s.subject, s.relation)
        new = writes.row(self.spark, "fact", {"subject": s.subject, "relation": s.relation, "object": s.object, "confidence": s.confidence}, self.ns, self._next(), self.now_ms)
        new = new.join(F.broadcast(parents.select("ns", "merge_parents").withColumnRenamed("ns", "_ns"))).withColumn("ns", F.col("_ns")).drop("_ns", "merge_parents")
        self.grains = writes.merge(self.grains, parents, new)
        return new

    def on_Remember(self, s: A.Remember, q, bound) -> DataFrame:
        o = {k: v[0] for k, v in s.options.items() if v}
        fields = {"content": s.content} | {k: o[a] for k, a in (("session_id", "session"), ("role", "role"), ("run_id", "run")) if a in o}
        new = writes.row(self.spark, "event", fields, self.ns, self._next(), self.now_ms)
        self.grains = writes.add(self.grains, new)
        return new

    def on_Forget(self, s: A.Forget, q, bound) -> DataFrame:
        gone = scans.by_hash(self.grains, s.hash) if s.hash else privacy.report_subject(self.grains.filter(F.col("ns") == self.ns), s.subject, s.text_mentions)
        self.grains = writes.forget(self.grains, gone)
        self._audit("forget", s.hash or s.subject, s.reason)
        return gone.select("hash")

    def on_Purge(self, s: A.Purge, q, bound) -> DataFrame:
        gone = privacy.purge(self.grains, self.now_ms - s.age_ms, s.ns or self.ns, s.grain_type, s.limit)
        self.grains = writes.forget(self.grains, gone)
        self._audit("purge", s.ns or self.ns, s.reason)
        return gone.select("hash")

    # registry and control
    def on_DefineQuery(self, s: A.DefineQuery, q, bound) -> DataFrame:
        if len(self.queries) >= 100 or len(s.body.encode()) > 8192 or len(s.params) > 10:
            raise QueryError("CAL-E058", "100 queries, 8 KiB and 10 parameters at most")
        parse(s.body)
        self.queries[s.name] = s
        return self.on_Describe(A.Describe("queries"), q, bound)

    def on_RunQuery(self, s: A.RunQuery, q, bound) -> DataFrame:
        saved = self.queries.get(s.name)
        if saved is None:
            raise QueryError("CAL-E056", f"no query is called {s.name}")
        missing = set(saved.params) - set(s.args)
        if missing:
            raise QueryError("CAL-E008", f"${sorted(missing)[0]} is not bound")
        return self.run(parse(saved.body), bound | s.args)

    def on_DefineTemplate(self, s: A.DefineTemplate, q, bound) -> DataFrame:
        if len(self.templates) >= 50:
            raise QueryError("CAL-E118", "50 templates at most")
        if s.extends == "data":
            raise QueryError("CAL-E119", "data can not be extended")
        self.templates[s.name] = s
        return self.on_Describe(A.Describe("templates"), q, bound)

    def meta(self, prefix: str) -> DataFrame:
        """(key, value) of the registry's entries whose key, qry:name or tpl:name, starts with prefix as it is written."""
        entries = [(f"qry:{n}", v.body) for n, v in self.queries.items()] + [(f"tpl:{n}", json.dumps(v.sections)) for n, v in self.templates.items()]
        return self.spark.createDataFrame(entries, "key string, value string").filter(F.startswith("key", F.lit(prefix)))

    def on_Drop(self, s: A.Drop, q, bound) -> DataFrame:
        (self.queries if s.kind == "query" else self.templates).pop(s.name, None)
        return self.on_Describe(A.Describe("queries" if s.kind == "query" else "templates"), q, bound)

    def on_Grant(self, s: A.Grant, q, bound) -> DataFrame:
        self.grants = [g for g in self.grants if not (g[0] == s.to and g[1] in s.verbs and g[2] == s.ns)]
        self.grants += [(s.to, v, s.ns, s.revoke) for v in s.verbs]
        return self.on_ShowGrants(s, q, bound)

    def on_ShowGrants(self, s, q, bound) -> DataFrame:
        return self.spark.createDataFrame(self.grants, "principal string, verb string, ns string, revoked boolean")

    def on_Governance(self, s: A.Governance, q, bound) -> DataFrame:
        self.audit.append({"verb": s.action, "target": s.target, "reason": s.reason, "principal": self.user})
        return self.spark.createDataFrame([(a["verb"], a["target"], a["reason"]) for a in self.audit], "action string, target string, reason string")


def _with_key(attrs, name: str, value):
    return F.map_concat(F.map_filter(attrs, lambda k, _: k != F.lit(name)), F.create_map(F.lit(name), value))


def _namespace(cond) -> str | None:
    if isinstance(cond, A.Both):
        return _namespace(cond.left) or _namespace(cond.right)
    if isinstance(cond, A.Compare) and cond.op == "=" and cond.field in ("ns", "namespace") and isinstance(cond.value, str):
        return cond.value
    return None


def _subject(cond) -> bool:
    """Whether a condition names one subject."""
    if isinstance(cond, A.Both):
        return _subject(cond.left) or _subject(cond.right)
    return isinstance(cond, A.Compare) and cond.op == "=" and cond.field == "subject"


def _anchored(cond) -> bool:
    if isinstance(cond, A.Both):
        return _anchored(cond.left) or _anchored(cond.right)
    return isinstance(cond, A.Compare | A.Within) and cond.field in ("subject", "session_id", "hash") and not getattr(cond, "negated", False)
