"""The query verbs over DataFrames of documents, with four physical strategies.

* ``vector``: one Arrow pass over the texts, tokens and matches as arrays (:mod:`spanloom.operators.columnar`); the chart runs
  over stretches that can hold a match, where a grammar needs trees. No shuffle, also on streams. The fastest plan for
  all grammars.
* ``array``: a grammar that unfolds into few sequences of predicates, or repeats one predicate at its root, is evaluated
  inside each row with higher-order functions: no shuffle and no Python workers, also on streams.
* ``relational``: rules become tables of (key, start, stop); a sequence is an equi-join on adjacency, alternatives are
  unions, a repeated predicate is found by gaps and islands. Only tokens that a predicate accepts leave their row.
* ``chart``: as ``vector``, but every match comes from a tree.

``auto`` keeps to the JVM where it can (``array``) and takes ``vector`` else.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.errors import GrammarError
from spanloom.functions.spans import resolve
from spanloom.functions.tokens import cut, fixed, join_with_gaps, running, with_tokens
from spanloom.operators.columnar import WORD_BITS, Plan, by_value, worker
from spanloom.operators.facts import Scheme, check_fields
from spanloom.plans import grammar as g
from spanloom.plans.grammar import Compiled, Symbol, compile_grammar
from spanloom.sources.lexicon import in_memory, with_forms, with_paradigms

#: Sequences and their length up to which a grammar is evaluated inside the row.
MAX_SEQUENCES, MAX_LENGTH = 64, 12
MATCH_FIELDS = "match_no int, tok_start int, tok_stop int, byte_start int, byte_stop int, text string, values array<string>"
FACT_FIELDS = "match_no int, fact_no int, name string, fields string, spans array<struct<start:int,stop:int>>, tok_start int, tok_stop int"

NODE_FIELDS = "match_no int, node_no int, parent_no int, depth int, rule int, label string, production int, tok_start int, tok_stop int, text string"


def unfold(compiled: Compiled) -> list[tuple] | None:
    """The sequences of predicates that the grammar stands for, or None if they are too many, too long or unbounded."""
    if compiled.is_recursive() or any(s.gazetteer for s in compiled.symbols):
        return None

    def of(symbol: Symbol) -> list[tuple]:
        out: list[tuple] = []
        for production in symbol.productions:
            sequences: list[tuple] = [()]
            for x in production:
                tails = of(x) if isinstance(x, Symbol) else [(x,)]
                sequences = [a + b for a in sequences for b in tails]
                if len(sequences) > MAX_SEQUENCES or max(map(len, sequences), default=0) > MAX_LENGTH:
                    raise OverflowError
            out += sequences
        if len(out) > MAX_SEQUENCES:
            raise OverflowError
        return out

    try:
        return [s for s in dict.fromkeys(of(compiled.root)) if s]
    except OverflowError:
        return None


def _bits_of(part: list) -> Callable[[Column], Column]:
    """Token -> the predicates that accept it, one bit each."""
    return lambda t: reduce(lambda a, b: a + b, [F.when(p.column(t), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, p in enumerate(part)], F.lit(0).cast("long"))


class Parser:
    """A grammar with its tokenisation, lexicon and tagger, and the verbs that run it over documents.

    ``lexicon``: a lexicon table; tokens of ``types`` get its forms. ``tagger``: a function from a token array column to a
    token array column. ``engine``: auto, vector, array, relational or chart. ``key``: a column that is unique by document.
    ``tokenizer``: a function from documents and the name of their text column to documents with a ``tokens`` column of TOKEN.
    """

    def __init__(self, grammar: g.Node, lexicon: DataFrame | None = None, types=("Russian",), tagger: Callable[[Column], Column] | None = None, engine: str = "auto", key: str = "doc_id", tokenizer: Callable[[DataFrame, str], DataFrame] | None = None):
        self.compiled = compile_grammar(grammar)
        self.compiled.validate()
        check_fields(self.compiled)
        self.lexicon, self.types, self.tagger, self.engine, self.key, self.tokenizer = lexicon, tuple(types), tagger, engine, key, tokenizer
        self.sequences = unfold(self.compiled)
        self.run = self._root_run()
        self._memory: tuple | None = None
        self._inflects = any(a.mode == "inflected" for a in self.compiled.wrappers("attribute"))

    # planning

    def _root_run(self) -> tuple | None:
        """(predicate, least length) if the grammar is one predicate, repeated without an upper bound."""
        node = self.compiled.source
        while isinstance(node, g.Wrapper) and node.kind != "relation" or isinstance(node, g.Alternatives) and len(node.sequences) == 1 and len(node.sequences[0]) == 1:
            node = node.inner if isinstance(node, g.Wrapper) else node.sequences[0][0]
        node = g.simplify_quantifier(node)
        if not (isinstance(node, g.OptionalRepeat) or isinstance(node, g.Repeat) and node.high is None):
            return None
        inner = node.inner
        while isinstance(inner, g.Wrapper) and inner.kind != "relation" or isinstance(inner, g.Alternatives) and len(inner.sequences) == 1 and len(inner.sequences[0]) == 1:
            inner = inner.inner if isinstance(inner, g.Wrapper) else inner.sequences[0][0]
        return (inner.predicate, getattr(node, "low", None) or 1) if isinstance(inner, g.Terminal) else None

    def strategy(self, verb: str = "findall", facts: bool = False) -> str:
        native = (self.sequences is not None or self.run and verb != "match") and len(self.compiled.predicates) <= WORD_BITS and not self.compiled.wrappers("relation")
        if self.engine == "auto":
            return "array" if native and not facts and verb in ("findall", "find", "match") else "vector"
        if self.engine == "array" and (not native or facts or verb not in ("findall", "find", "match")):
            raise GrammarError("this grammar or verb has no array plan")
        if self.engine == "relational" and (facts or verb not in ("findall", "extract") or self.compiled.wrappers("relation")):
            raise GrammarError("the relational plan has spans only")
        return self.engine

    # preparation

    def prepare(self, docs: DataFrame, text_col: str = "text", native: bool = False) -> DataFrame:
        """key and tokens (and paradigms): tokenised unless ``docs`` has tokens, with forms and the tagger applied."""
        if "tokens" in docs.columns or self.tokenizer:
            out = docs if "tokens" in docs.columns else self.tokenizer(docs, text_col)
            out = out.select(self.key, "tokens").filter(F.col("tokens").isNotNull())
        else:  # a filter on the tokens would tokenise once more
            out = with_tokens(docs.select(self.key, text_col).filter(F.col(text_col).isNotNull()), text_col, native=native).select(self.key, "tokens")
        if self.lexicon is not None:
            out = with_forms(out, self.lexicon, self.types, self.key)
        if self.tagger:
            out = out.withColumn("tokens", F.transform(self.tagger(F.col("tokens")), lambda t, i: t.withField("idx", i)))
        return with_paradigms(out, self.lexicon, self.key) if self._inflects and self.lexicon is not None else out

    def _masks(self, prepared: DataFrame) -> tuple[DataFrame, list[str]]:
        """One column of bit sets a token for each WORD_BITS predicates."""
        names = []
        for at in range(0, max(len(self.compiled.predicates), 1), WORD_BITS):
            part = self.compiled.predicates[at : at + WORD_BITS]
            names.append(f"__mask{len(names)}")
            prepared = fixed(prepared, {names[-1]: F.transform("tokens", _bits_of(part))})
        return prepared, names

    # verbs

    def findall(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """key and MATCH_FIELDS: matches without conflicts, numbered from 0 in order."""
        return self._matches(docs, "findall", text_col)

    def find(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """The first match of each document that has one."""
        return self._matches(docs, "find", text_col)

    def match(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """Documents that match as a whole, by their best tree."""
        return self._matches(docs, "match", text_col)

    def parse(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """The best tree of any range, without resolving conflicts: the token-level find."""
        return self._matches(docs, "parse", text_col)

    def extract(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """Every tree, unresolved (relational plan: every range)."""
        return self._matches(docs, "extract", text_col)

    def findall_text(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        return self.findall(docs, text_col).select(self.key, "match_no", "values")

    def find_text(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        return self.find(docs, text_col).select(self.key, "values")

    def _matches(self, docs: DataFrame, verb: str, text_col: str) -> DataFrame:
        plan = self.strategy(verb)
        if plan == "array":
            return self._array(self.prepare(docs, text_col, native=True), verb)
        if plan == "relational":
            return self._relational(docs, text_col, verb)
        return self._vector(docs, text_col, verb, "matches", plan == "chart")

    def facts(self, docs: DataFrame, verb: str = "findall", text_col: str = "text") -> DataFrame:
        """key and FACT_FIELDS: all facts of the matches, outer ones first; ``fields`` is JSON in the scheme's order, and
        tok_start and tok_stop are the range of the match."""
        self.strategy(verb, facts=True)
        return self._vector(docs, text_col, verb, "facts")

    def nodes(self, docs: DataFrame, verb: str = "findall", text_col: str = "text") -> DataFrame:
        """key and NODE_FIELDS: the trees of the matches, one row a node, numbered from the root down: ``rule`` and ``label``
        find nodes by rule, rows without a rule are the leaves."""
        return self._vector(docs, text_col, verb, "nodes")

    def chart(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """Debugging: every completed tree as nested text."""
        return self._vector(docs, text_col, "extract", "trees")

    # array plan

    def _array(self, prepared: DataFrame, verb: str) -> DataFrame:
        masked, _ = self._masks(prepared)
        n = F.size("tokens")
        has = lambda i, p: F.get("__mask0", i).bitwiseAND(F.lit(1 << self.compiled.predicates.index(p))) != 0
        every = lambda i, s: reduce(lambda a, b: a & b, [has(i + k, p) for k, p in enumerate(s)])
        spot = lambda start, stop: F.struct(start.cast("int").alias("start"), stop.cast("int").alias("stop"))
        places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        if self.run and verb != "match":
            p, low = self.run
            hit = lambda i: F.coalesce(has(i, p), F.lit(False))
            before = lambda i: F.when(i > 0, hit(F.greatest(i - 1, F.lit(0)))).otherwise(F.lit(False))
            masked = fixed(masked, {"__starts": F.filter(places, lambda i: hit(i) & ~before(i)), "__ends": F.filter(places, lambda i: hit(i) & ~hit(i + 1))})
            spans = F.filter(F.zip_with("__starts", "__ends", lambda a, b: spot(a, b + 1)), lambda s: s["stop"] - s["start"] >= low)
        elif verb == "match":
            whole = [(n == len(s)) & every(F.lit(0), s) for s in self.sequences]
            spans = F.when(F.coalesce(reduce(lambda a, b: a | b, whole), F.lit(False)), F.array(spot(F.lit(0), n)))
        else:
            ordered = sorted(self.sequences, key=len, reverse=True)  # only the longest match at a start can last

            def longest(i: Column) -> Column:
                return F.coalesce(*[F.when(every(i, s), i + len(s)) for s in ordered])

            masked = fixed(masked, {"__found": F.filter(F.transform(places, lambda i: spot(i, longest(i))), lambda s: s["stop"].isNotNull())})
            reach = running(F.transform("__found", lambda s: s["stop"]), F.greatest)
            before = F.concat(F.array(F.lit(-1)), reach)  # how far the spans before each one reach
            records = F.filter(F.zip_with("__found", F.slice(before, F.lit(1), F.size("__found")), lambda s, b: F.when(s["stop"] > b, s)), lambda s: s.isNotNull())
            masked = fixed(masked, {"__records": records})
            following = F.concat(F.slice("__records", F.lit(2), F.greatest(F.size("__records"), F.lit(1))), F.array(F.lit(None).cast("struct<start:int,stop:int>")))
            spans = F.filter(F.zip_with("__records", F.slice(following, F.lit(1), F.size("__records")), lambda s, n: F.when(n.isNull() | (n["start"] >= s["stop"]), s)), lambda s: s.isNotNull())
        found = fixed(masked, {"__spans": F.slice(spans, 1, 1) if verb == "find" else spans})
        return self._described(found)

    def _described(self, found: DataFrame) -> DataFrame:
        """key and MATCH_FIELDS from key, tokens and ``__spans``, in the row: no match carries its document's tokens along."""
        taken = lambda s, i: F.struct(i.alias("match_no"), s["start"].alias("tok_start"), s["stop"].alias("tok_stop"), cut(F.col("tokens"), s["start"], s["stop"]).alias("cut"))
        rows = fixed(found.select(self.key, "tokens", "__spans"), {"__matches": F.transform("__spans", taken)}).select(self.key, F.inline("__matches"))
        return rows.select(
            self.key, "match_no", "tok_start", "tok_stop", F.get("cut", F.lit(0))["byte_start"].alias("byte_start"), F.element_at("cut", -1)["byte_stop"].alias("byte_stop"),
            join_with_gaps(F.col("cut")).alias("text"), F.transform("cut", lambda t: t["value"]).alias("values"),
        )

    # relational plan

    def _relational(self, docs: DataFrame, text_col: str, verb: str) -> DataFrame:
        """All joins are merged by hint: Spark's estimate of exploded tokens leaves out their number, so that it would broadcast
        tables of tokens far over its threshold, through the driver."""
        key, prepared = self.key, self.prepare(docs, text_col)
        # the generator of one row keeps the filter that Spark derives for the next one from tokenising once more
        apart = fixed(prepared.select(key, F.col("tokens").alias("__made")), {"tokens": F.col("__made")})
        tokens = apart.select(key, F.posexplode("tokens").alias("start", "token"))
        memo: dict[int, tuple[DataFrame | None, bool]] = {}

        def accepted(p) -> DataFrame:
            return tokens.filter(p.column(F.col("token"))).select(key, "start", (F.col("start") + 1).alias("stop"))

        def joined(a: DataFrame | None, b: DataFrame | None) -> DataFrame | None:
            if a is None or b is None:
                return None
            right = b.select(F.col(key), F.col("start").alias("stop"), F.col("stop").alias("end"))
            return a.join(right.hint("merge"), [key, "stop"]).select(key, "start", F.col("end").alias("stop"))

        def union(parts: list[DataFrame | None]) -> DataFrame | None:
            parts = [x for x in parts if x is not None]
            return reduce(lambda a, b: a.unionByName(b), parts).distinct() if parts else None

        def runs(p) -> DataFrame:
            """All stretches within maximal runs of accepted tokens."""
            order = Window.partitionBy(key).orderBy("start")
            islands = accepted(p).withColumn("island", F.col("start") - F.row_number().over(order))
            ends = islands.groupBy(key, "island").agg(F.max("stop").alias("end"))
            return islands.join(ends.hint("merge"), [key, "island"]).select(key, "start", F.explode(F.sequence(F.col("start") + 1, F.col("end"))).alias("stop"))

        def spans(s: Symbol) -> tuple[DataFrame | None, bool]:
            """Non-empty spans of a rule, and whether it may be empty."""
            if s.number in memo:
                return memo[s.number]
            if s.gazetteer:
                raise GrammarError("use gazetteer_spans for phrases in relational plans")
            repeated = [q for q in s.productions if s in q]
            if repeated:
                rest = [q for q in s.productions if s not in q]
                items = {id(q[0]) for q in repeated} | {id(q[0]) for q in rest if q}
                if any(len(q) != 2 or q[1] is not s or isinstance(q[0], Symbol) for q in repeated) or len(items) != 1:
                    raise GrammarError("the relational plan repeats single predicates only")
                memo[s.number] = runs(repeated[0][0]), s.nullable
                return memo[s.number]
            parts = []
            for q in s.productions:
                now, empty = None, True
                for x in q:
                    more, may = spans(x) if isinstance(x, Symbol) else (accepted(x), False)
                    now, empty = union([joined(now, more), now if may else None, more if empty else None]), empty and may
                parts.append(now)
            memo[s.number] = union(parts), s.nullable
            return memo[s.number]

        if self.compiled.is_recursive(beyond_repeats=True):
            raise GrammarError("the relational plan has no recursion")
        found = spans(self.compiled.root)[0]
        if found is None:
            found = tokens.select(key, "start", F.col("start").alias("stop")).limit(0)
        if verb == "findall":
            found = resolve(found, key)
        ordered = F.array_sort(F.collect_list(F.struct("start", (-F.col("stop")).alias("end"))))  # a document's spans
        spans = found.groupBy(key).agg(F.transform(ordered, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("stop"))).alias("__spans"))
        if "tokens" in docs.columns or self.tokenizer or self.tagger or self.lexicon is not None:
            return self._described(spans.join(prepared.select(key, "tokens").hint("merge"), key))
        # texts are shuffled, not their tokens, which are many times as large
        return self._described(with_tokens(spans.join(docs.select(key, text_col).hint("merge"), key), text_col))

    # vector and chart plan

    def _vector(self, docs: DataFrame, text_col: str, verb: str, what: str, trees: bool = False) -> DataFrame:
        key, words = self.key, None
        plain = not self.tagger and not self.tokenizer and "tokens" not in docs.columns
        if self.lexicon is not None and plain:
            words = self._memory = self._memory or in_memory(self.lexicon)
        fused = plain and (self.lexicon is None or words) and all(map(by_value, self.compiled.predicates))
        forms, paradigms = words if fused and words else (None, None)
        unfolds = not trees and len(self.compiled.predicates) <= WORD_BITS
        plan = Plan(self.compiled, verb, what, self.sequences if unfolds else None, self.run if unfolds else None, forms, paradigms if self._inflects else None, self.types, "text" if fused else "tokens")
        if fused:
            sent = docs.select(F.col(key).alias("__key"), F.col(text_col).alias("text"))
        else:
            masked, names = self._masks(self.prepare(docs, text_col))
            own = F.col("paradigms") if "paradigms" in masked.columns else F.lit(None)
            sent = masked.select(F.col(key).alias("__key"), "tokens", F.array(*names).alias("masks"), own.cast("array<struct<lemma_id:bigint,rank:int,form:string,grams:array<string>>>").alias("paradigms"))
        fields = {"trees": "tree string", "nodes": NODE_FIELDS, "facts": FACT_FIELDS, "matches": MATCH_FIELDS}[what]
        key_type = docs.schema[key].dataType.simpleString()
        return sent.mapInArrow(worker(plan), f"__key {key_type}, {fields}").withColumnRenamed("__key", key)


# sinks


def typed(facts: DataFrame, scheme: Scheme) -> DataFrame:
    """Facts of one scheme with ``fields`` as a struct."""
    return facts.filter(F.col("name") == scheme.name).withColumn("fields", F.from_json("fields", scheme.ddl()))


def facts_json(facts: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, json: {"name", "fields", "spans"} of each fact, fields in the scheme's order."""
    text = F.concat(F.lit('{"name":'), F.to_json(F.array("name")).substr(F.lit(2), F.length(F.to_json(F.array("name"))) - 2), F.lit(',"fields":'), F.col("fields"), F.lit(',"spans":'), F.to_json("spans"), F.lit("}"))
    return facts.select(key, text.alias("json"))
