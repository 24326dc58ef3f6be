"""Recursive-descent parser of the query language."""

from __future__ import annotations

from ..schema import PLURALS, TYPES
from . import ast as A
from .lexer import QueryError, Token, lex

MAX_DEPTH, MAX_IN, MAX_STAGES, MAX_OPERANDS, MAX_BATCH, MAX_LIMIT, MAX_LETS = 8, 100, 5, 4, 10, 1000, 5
FORMATS = {"structured": "sml", "readable": "markdown", "compact": "text", "data": "json"}
WRITES = ("ADD", "SUPERSEDE", "ACCUMULATE", "MERGE", "REMEMBER", "FORGET", "PURGE", "GRANT", "REVOKE", "DEFINE", "DROP", "REVERT", "APPROVE", "REJECT", "APPLY", "ROLLBACK")


class Parser:
    def __init__(self, source: str):
        self.tokens, self.at, self.depth = lex(source), 0, 0

    # tokens
    def peek(self, ahead: int = 0) -> Token:
        return self.tokens[min(self.at + ahead, len(self.tokens) - 1)]

    def take(self) -> Token:
        t = self.peek()
        self.at += 1
        return t

    def fail(self, wanted: str) -> QueryError:
        return QueryError("CAL-E002", f"expected {wanted}, found {self.peek().text or 'the end'!r}")

    def word(self, *names: str) -> bool:
        if self.peek().is_word(*names):
            self.at += 1
            return True
        return False

    def need(self, *names: str) -> str:
        if not self.peek().is_word(*names):
            raise self.fail(" or ".join(names))
        return self.take().text.upper()

    def op(self, text: str) -> bool:
        if self.peek().kind == "op" and self.peek().text == text:
            self.at += 1
            return True
        return False

    def need_op(self, text: str) -> None:
        if not self.op(text):
            raise self.fail(repr(text))

    def string(self) -> str:
        if self.peek().kind != "string":
            raise self.fail("a string")
        return self.take().value

    def name(self) -> str:
        if self.peek().kind not in ("word", "string"):
            raise self.fail("a name")
        t = self.take()
        return t.value if t.kind == "string" else t.text

    def number(self) -> float:
        if self.peek().kind != "number":
            raise self.fail("a number")
        return self.take().value

    def count(self, most: int = MAX_LIMIT) -> int:
        n = self.number()
        if n != int(n) or not 1 <= n <= most:
            raise QueryError("CAL-E010", f"{n:g} is not a whole number from 1 to {most}")
        return int(n)

    def hash(self) -> str:
        if self.peek().kind != "hash":
            raise self.fail("sha256:<hash>")
        return self.take().value

    # queries
    def parse(self) -> A.Query:
        lets = []
        while self.word("LET"):
            lets.append(self.let())
        if len(lets) > MAX_LETS:
            raise QueryError("CAL-E011", f"at most {MAX_LETS} LET bindings")
        q = self.query()
        q.lets = lets
        self.op(";")
        if self.peek().kind != "end":
            raise self.fail("the end of the query")
        return q

    def let(self) -> A.Let:
        if self.peek().kind != "param":
            raise self.fail("a $name")
        name = self.take().text[1:]
        self.need_op("=")
        extractor = self.need("SUBJECTS", "OBJECTS", "HASHES").lower()
        self.need("OF")
        self.need_op("(")
        sub = self.query()
        self.need_op(")")
        self.need_op(";")
        return A.Let(name, extractor, sub)

    def query(self) -> A.Query:
        q = A.Query(self.statement())
        for _ in range(64):
            if self.op("|"):
                q.stages.append(self.stage())
            elif self.peek().is_word("ORDER", "OFFSET") or self.peek().is_word("LIMIT") and not isinstance(q.statement, A.Recall):
                q.stages.append(self.stage())
            elif self.word("WITH"):
                q.options |= self.options()
            elif self.word("FORMAT", "AS"):
                q.formats += self.formats()
            elif isinstance(q.statement, A.SetOp) and self.word("WHERE"):
                q.where_after = self.condition()
            else:
                break
        if len(q.stages) > MAX_STAGES:
            raise QueryError("CAL-E012", f"at most {MAX_STAGES} pipeline stages")
        return q

    def stage(self) -> A.Stage:
        if self.word("SELECT"):
            return A.Stage("select", tuple(self.names()))
        if self.word("PROJECT"):
            pairs = []
            while True:
                f = self.name()
                pairs.append((f, self.name() if self.word("AS") else f))
                if not self.op(","):
                    return A.Stage("project", tuple(pairs))
        if self.word("ORDER"):
            self.need("BY")
            f = self.name()
            down = self.word("DESC")
            if not down:
                self.word("ASC")
            return A.Stage("order", (f, down))
        if self.word("LIMIT"):
            return A.Stage("limit", (self.count(),))
        if self.word("OFFSET"):
            return A.Stage("offset", (int(self.number()),))
        if self.word("GROUP"):
            self.need("BY")
            return A.Stage("group", (self.name(),))
        for one in ("COUNT", "FIRST", "SUBJECTS", "OBJECTS", "HASHES"):
            if self.word(one):
                return A.Stage(one.lower())
        raise self.fail("SELECT, PROJECT, ORDER BY, LIMIT, OFFSET, COUNT, FIRST, SUBJECTS, OBJECTS, HASHES or GROUP BY")

    def names(self) -> list[str]:
        out = [self.name()]
        while self.op(","):
            out.append(self.name())
        return out

    def options(self) -> dict:
        out = {}
        while True:
            name, args = self.name().lower(), []
            if self.op("("):
                while not self.op(")"):
                    t = self.take()
                    args.append(t.value if t.kind in ("string", "number") else t.text)
                    self.op(",")
            out[name] = args
            if not self.op(","):
                return out

    def formats(self) -> list[tuple[str, str | None]]:
        def one() -> tuple[str, str | None]:
            f = self.name()
            if f.upper() in ("TEMPLATE", "PRESET"):
                quoted = self.peek().kind == "string"
                return ("inline:" if quoted and f.upper() == "TEMPLATE" else "template:") + self.name(), None
            return FORMATS.get(f.lower(), f.lower()), self.name() if self.word("AS") else None

        if not self.op("["):
            return [one()]
        out = [one()]
        while self.op(","):
            out.append(one())
        self.need_op("]")
        return out

    # statements
    def statement(self):
        t = self.peek()
        if t.kind != "word":
            raise self.fail("a statement")
        method = getattr(self, f"do_{t.text.lower()}", None)
        if method is None:
            raise self.fail("a statement")
        self.at += 1
        return method()

    def recall(self) -> A.Recall:
        mine = self.word("MY")
        kind = self.grain_type()
        r = A.Recall(kind, mine=mine)
        while True:
            if self.word("ABOUT", "LIKE"):
                if r.about is not None:
                    raise QueryError("CAL-E013", "ABOUT and LIKE are one free-text query")
                r.about = self.string()
                if self.word("AND"):
                    r.where = self.joined(r.where, self.condition())
            elif self.word("WHERE"):
                r.where = self.joined(r.where, self.condition())
            elif self.word("RECENT"):
                r.recent = self.count()
            elif self.word("SINCE"):
                r.since = self.string()
            elif self.word("UNTIL"):
                r.until = self.string()
            elif self.word("BETWEEN"):
                if r.since is not None:
                    raise QueryError("CAL-E013", "SINCE and BETWEEN can not be combined")
                r.since = self.string()
                self.need("AND")
                r.until = self.string()
            elif self.word("CONTRADICTIONS"):
                r.contradictions = True
                if self.word("OF"):
                    self.need_op("(")
                    r.contradictions_of = self.query()
                    self.need_op(")")
            elif self.word("LIMIT"):
                if r.recent is not None:
                    raise QueryError("CAL-E013", "RECENT and LIMIT can not be combined")
                r.limit = self.count()
            else:
                return r

    @staticmethod
    def joined(a, b):
        return b if a is None else A.Both(a, b)

    def grain_type(self) -> str | None:
        if self.op("*") or self.word("GRAINS", "ALL"):
            return None
        t = self.peek()
        low = t.text.lower()
        if t.kind == "word" and (low in PLURALS or low in TYPES):
            self.at += 1
            return PLURALS.get(low, low)
        if t.is_word("WHERE", "ABOUT", "LIKE", "RECENT"):
            return None
        raise self.fail("a grain type")

    def do_recall(self):
        first = self.recall()
        operands, op = [first], None
        while self.peek().is_word("UNION", "INTERSECT", "EXCEPT"):
            now = self.take().text.lower()
            if op not in (None, now):
                raise QueryError("CAL-E014", "set operations of one kind only can be chained")
            op = now
            self.need("RECALL")
            operands.append(self.recall())
        if len(operands) > MAX_OPERANDS:
            raise QueryError("CAL-E014", f"at most {MAX_OPERANDS} operands")
        return first if op is None else A.SetOp(op, operands)

    def do_exists(self):
        return A.Exists(self.recall())

    def do_history(self):
        if self.word("OF"):
            h = self.hash()
            return A.History(h, diff=self.hash() if self.word("DIFF") else None)
        self.need("WHERE")
        return A.History(where=self.condition())

    def do_stream(self):
        self.need("ASSEMBLE")
        out = self.do_assemble()
        out.stream = True
        return out

    def do_assemble(self):
        out = A.Assemble(self.string() if self.peek().kind == "string" else self.name(), [])
        if self.word("FOR"):
            out.audience = self.name()
        self.need("FROM")
        if self.peek().kind == "hash":
            hashes = [self.hash()]
            while self.op(","):
                hashes.append(self.hash())
            out.sources.append(A.Source("hashes", hashes=hashes))
        elif self.peek(1).text == ":":
            while True:
                out.sources.append(self.source())
                if not self.op(","):
                    break
        else:
            out.sources.append(A.Source("main", A.Query(self.recall())))
        if self.word("BUDGET"):
            out.budget = int(self.number())
            if self.peek().is_word("TOKENS", "GRAINS"):
                out.unit = self.take().text.lower()
        if self.word("PRIORITY"):
            out.priority = self.priority()
            unknown = set(out.priority) - {s.label for s in out.sources}
            if unknown:
                raise QueryError("CAL-E035", f"no source is called {sorted(unknown)[0]}")
        if self.peek().is_word("BUDGET", "FOR"):
            raise QueryError("CAL-E036", "the order is FOR, FROM, BUDGET, PRIORITY, FORMAT, WITH")
        return out

    def source(self) -> A.Source:
        label = self.name()
        self.need_op(":")
        pin = self.word("PIN")
        if self.word("LITERAL"):
            return A.Source(label, literal=self.string(), pin=pin)
        self.need_op("(")
        q = self.query()
        self.need_op(")")
        return A.Source(label, q, pin=pin)

    def priority(self) -> dict[str, float]:
        first = self.name()
        if self.op(":"):
            out = {first: self.number()}
            while self.op(","):
                label = self.name()
                self.need_op(":")
                out[label] = self.number()
            return out
        chain = [first]
        while self.op(">"):
            chain.append(self.name())
        return {c: (len(chain) - i) / len(chain) for i, c in enumerate(chain)}

    def do_coalesce(self):
        branches = []
        while True:
            self.need_op("{")
            branches.append(self.query())
            self.need_op("}")
            if not self.word("OR", "ELSE"):
                return A.Coalesce(branches)

    def do_batch(self):
        entries: dict[str, A.Query] = {}
        self.need_op("{")
        while not self.op("}"):
            label = str(len(entries))
            if self.peek(1).text == ":" and self.peek().kind in ("word", "string"):
                label = self.name()
                self.need_op(":")
            entries[label] = self.query()
            if not self.op(";"):
                self.op(",")
        if len(entries) > MAX_BATCH:
            raise QueryError("CAL-E015", f"at most {MAX_BATCH} entries")
        return A.Batch(entries)

    def do_entity(self):
        s = self.string()
        self.need("RELATION")
        r = self.string()
        self.need("AT")
        return A.EntityAt(s, r, int(self.number()), self.need("WORLD", "KNOWLEDGE").lower() if self.word("AXIS") else "world")

    def do_run(self):
        if self.word("TRACE"):
            return A.RunTrace(self.string(), self.count() if self.word("LIMIT") else None)
        if self.word("LOOP"):
            return A.Governance("run_loop", "")
        name, args = self.string(), {}
        if self.op("("):
            while not self.op(")"):
                p = self.take().text.lstrip("$")
                self.need_op("=")
                args[p] = self.value()
                self.op(",")
        return A.RunQuery(name, args)

    def do_runs(self):
        self.need("TOUCHING")
        return A.RunsTouching(self.hash(), self.count(8) if self.word("DEPTH") else 8)

    def do_derived(self):
        self.need("FROM")
        return A.DerivedFrom(self.hash())

    def do_show(self):
        return A.ShowForks() if self.need("FORKS", "GRANTS") == "FORKS" else A.ShowGrants()

    def do_related(self):
        out = A.Related(self.string(), [])
        self.need("VIA")
        out.via = [x.strip() for x in self.string().split(",") if x.strip()]
        while True:
            if self.word("DIRECTION"):
                out.direction = self.need("OUT", "IN", "BOTH").lower()
            elif self.word("DEPTH"):
                out.depth = self.count(4)
            elif self.word("LIMIT"):
                out.limit = self.count(256)
            else:
                return out

    def do_novelty(self):
        out = A.Novelty(self.string())
        while True:
            if self.word("SUBJECT"):
                out.subject = self.string()
            elif self.word("RELATION"):
                out.relation = self.string()
            elif self.word("LIMIT"):
                out.limit = self.count()
            else:
                return out

    def do_describe(self):
        what = self.name().lower()
        return A.Describe(what, self.name().lower() if self.peek().kind == "word" and not self.peek().is_word("FORMAT", "WITH", "AS") else None)

    def do_explain(self):
        return A.Explain(self.query())

    def do_report(self):
        self.need("SUBJECT")
        return A.ReportSubject(self.string(), self.mentions())

    def mentions(self) -> bool:
        if self.peek().is_word("WITH") and self.peek(1).is_word("TEXT_MENTIONS"):
            self.at += 2
            return True
        return False

    def fields(self) -> dict:
        out = {}
        while self.word("SET"):
            f = self.name()
            self.need_op("=")
            out[f] = self.value()
        return out

    def reason(self, needed: bool = True) -> str | None:
        if self.word("REASON", "BECAUSE"):
            return self.string()
        if needed:
            raise QueryError("CAL-E020", "a REASON or BECAUSE is needed")
        return None

    def do_add(self):
        if self.word("WORKFLOW"):
            return self.workflow(None)
        kind = self.name().lower()
        if kind not in TYPES:
            raise QueryError("CAL-E021", f"{kind} can not be added")
        fields = self.fields()
        options = self.options() if self.word("WITH") else {}
        return A.Add(kind, fields, self.reason(), options)

    def workflow(self, supersedes: str | None):
        name, edges, bindings = self.string(), [], {}
        while self.peek().kind == "word" and not self.peek().is_word("BIND", "REASON", "BECAUSE"):
            a = self.name()
            while self.op("->"):
                b = self.name()
                edges.append((a, b))
                a = b
            self.op(",")
        while self.word("BIND"):
            n = self.name()
            self.need_op("=")
            bindings[n] = self.string()
        return A.AddWorkflow(name, edges, bindings, self.reason(), supersedes)

    def do_supersede(self):
        if self.word("WORKFLOW"):
            return self.workflow(self.hash())
        return A.Supersede(self.hash(), self.fields(), self.reason())

    def do_accumulate(self):
        kind = self.grain_type() or "state"
        self.need("WHERE")
        where, adds, sets = self.condition(), {}, {}
        while self.peek().is_word("ADD", "SET"):
            into = adds if self.take().text.upper() == "ADD" else sets
            f = self.name()
            self.need_op("=")
            into[f] = self.value()
        return A.Accumulate(kind, where, adds, sets, self.reason())

    def do_merge(self):
        s = self.string()
        self.need("RELATION")
        r = self.string()
        self.need("TO")
        o = self.string()
        c = self.number() if self.word("CONFIDENCE") else 1.0
        return A.Merge(s, r, o, c, self.reason())

    def do_remember(self):
        text = self.string()
        return A.Remember(text, self.options() if self.word("WITH") else {})

    def do_forget(self):
        if self.word("SUBJECT"):
            return A.Forget(subject=self.string(), text_mentions=self.mentions(), reason=self.reason())
        return A.Forget(self.hash(), reason=self.reason(False))

    def do_purge(self):
        self.need("OLDER")
        self.need("THAN")
        if self.peek().kind != "age":
            raise self.fail("an age such as 90d")
        age = self.take().text
        ms = int(age[:-1]) * {"d": 86_400_000, "h": 3_600_000, "m": 60_000}[age[-1]]
        kind = self.name().lower() if self.word("TYPE") else None
        ns = self.string() if self.word("IN") else None
        return A.Purge(ms, kind, ns, self.count() if self.word("LIMIT") else 1000, self.reason())

    def do_define(self):
        if self.need("QUERY", "TEMPLATE") == "TEMPLATE":
            name, extends, sections = self.name(), None, {}
            if self.word("AS"):
                return A.DefineTemplate(name, {"element": self.string()})
            if self.word("EXTENDS"):
                extends = self.name()
            while self.peek().kind == "word":
                section = self.name().lower()
                self.need_op("{")
                sections[section] = self.string()
                self.need_op("}")
            return A.DefineTemplate(name, sections, extends)
        name, params = self.string(), []
        if self.op("("):
            while not self.op(")"):
                params.append(self.take().text.lstrip("$"))
                self.op(",")
        if self.word("DESCRIPTION"):
            self.string()
        self.need("AS")
        self.need_op("{")
        begin, depth = self.at, 1
        while depth:
            t = self.take()
            if t.kind == "end":
                raise self.fail("'}'")
            depth += (t.text == "{") - (t.text == "}")
        body = self.tokens[begin : self.at - 1]
        if any(t.is_word(*WRITES) for t in body):
            raise QueryError("CAL-E057", "a saved query only reads")
        return A.DefineQuery(name, params, " ".join(t.text for t in body))

    def do_drop(self):
        kind = self.need("QUERY", "TEMPLATE").lower()
        return A.Drop(kind, self.name())

    def do_grant(self, revoke: bool = False):
        verbs = [v.lower() for v in self.names()]
        self.need("ON")
        ns = "*" if self.op("*") else self.string()
        self.need("FROM" if revoke else "TO")
        return A.Grant(verbs, ns, self.string(), revoke)

    def do_revoke(self):
        return self.do_grant(revoke=True)

    def governance(self, action: str):
        t = self.take()
        return A.Governance(action, str(t.value), self.reason(False))

    def do_approve(self):
        return self.governance("approve")

    def do_reject(self):
        return self.governance("reject")

    def do_apply(self):
        return self.governance("apply")

    def do_rollback(self):
        return self.governance("rollback")

    def do_revert(self):
        raise QueryError("CAL-E090", "REVERT is not supported")

    # conditions
    def condition(self):
        return self.either()

    def either(self):
        left = self.both()
        while self.word("OR"):
            left = A.Either(left, self.both())
        return left

    def both(self):
        left = self.negation()
        while self.word("AND"):
            left = A.Both(left, self.negation())
        return left

    def negation(self):
        self.depth += 1
        if self.depth > MAX_DEPTH:
            raise QueryError("CAL-E016", f"conditions nest {MAX_DEPTH} deep at most")
        try:
            if self.word("NOT"):
                return A.Not(self.negation())
            if self.op("("):
                inner = self.either()
                self.need_op(")")
                return inner
            return self.leaf()
        finally:
            self.depth -= 1

    def leaf(self):
        field = self.name()
        if self.word("IS"):
            if self.word("NOT"):
                self.need("NULL")
                return A.IsNull(field, True)
            return A.IsNull(field) if self.word("NULL") else A.IsCategory(field, self.name().lower())
        if self.word("CONTAINS"):
            return A.Matches(field, "contains", self.string())
        if self.word("STARTS"):
            self.need("WITH")
            return A.Matches(field, "starts", self.string())
        negated = self.word("NOT")
        if self.word("IN"):
            if self.peek().kind == "param":
                return A.Within(field, A.Param(self.take().text[1:]), negated)
            self.need_op("(")
            values = []
            while not self.op(")"):
                values.append(self.value())
                self.op(",")
            if len(values) > MAX_IN:
                raise QueryError("CAL-E017", f"at most {MAX_IN} values")
            return A.Within(field, values, negated)
        for op in ("<=", ">=", "!=", "=", "<", ">"):
            if self.op(op):
                return A.Compare(field, op, self.value())
        raise self.fail("a comparison")

    def value(self):
        t = self.take()
        if t.kind in ("string", "number", "hash"):
            return t.value
        if t.kind == "param":
            return A.Param(t.text[1:])
        if t.is_word("TRUE", "FALSE"):
            return t.text.upper() == "TRUE"
        if t.text == "[":
            out = []
            while not self.op("]"):
                out.append(self.value())
                self.op(",")
            return out
        self.at -= 1
        raise self.fail("a value")


def parse(source: str) -> A.Query:
    return Parser(source).parse()
