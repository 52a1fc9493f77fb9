"""Secret scans behind an inverted index of trigrams.

Each rule's expression is turned into a Boolean query over trigrams: which
three-letter strings a text must hold for the rule to match at all. The
trigrams that any rule asks for are looked up in every lowered text, which
gives their posting lists; intersecting and uniting these leaves the rows
where a rule may match, and only there it is run. A rule without a mandatory
trigram is run on every row. Only DataFrame functions are used.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from re import _constants as op  # the parse tree of the standard library
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from draftweave.llm.storage import stored


@dataclass(frozen=True)
class Rule:
    """``pattern`` in the syntax shared by Java and Python; ``least`` characters are asked of ``group``."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The base rules, in their order (fixed values).
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
)

#: Further public key formats.
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[baprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url_login", r"[a-z]{2,12}://[^\x09-\x0d\x20/:@]{1,64}:[^\x09-\x0d\x20/:@]{1,64}@[a-z0-9.-]{3,}"),
    Rule("bearer", r"(?i)bearer\x20+[A-Za-z0-9._~+/-]{20,}"),
)

#: Strings kept of one sub-expression before only their trigrams are.
_MOST_STRINGS = 64

#: A query is a set of alternatives, each a set of trigrams that must all occur; ``{()}`` says nothing.
Query = frozenset
ANY: Query = frozenset({frozenset()})


def _both(a: Query, b: Query) -> Query:
    joined = {x | y for x in a for y in b}
    return _simple(joined)


def _simple(parts: set) -> Query:
    kept = {x for x in parts if not any(y < x for y in parts)}
    return frozenset(kept) if len(kept) <= _MOST_STRINGS else frozenset({frozenset.intersection(*kept)})


def _of_string(text: str) -> frozenset:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _of_strings(texts: set[str]) -> Query:
    return _simple({_of_string(x) for x in texts})


def _one(kind, value) -> tuple[set[str] | None, Query]:
    if kind is op.LITERAL:
        return {chr(value).lower()}, ANY
    if kind is op.SUBPATTERN:
        return _whole(value[-1])
    if kind is op.BRANCH:
        parts = [_whole(x) for x in value[1]]
        if all(x is not None for x, _ in parts):
            union = set().union(*(x for x, _ in parts))
            if len(union) <= _MOST_STRINGS:
                return union, _simple(set().union(*(q for _, q in parts)))
        return None, _simple(set().union(*(_both(q, _of_strings(x)) if x is not None else q for x, q in parts)))
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT):
        least, most, body = value
        exact, query = _whole(body)
        if exact is not None and least == most == 1:
            return exact, query
        if exact is not None and (least, most) == (0, 1):
            return exact | {""}, ANY
        if least == 0:
            return None, ANY
        return None, _both(query, _of_strings(exact)) if exact is not None else query
    if kind is op.AT:
        return {""}, ANY
    if kind is op.IN:
        chars = {chr(v).lower() for k, v in value if k is op.LITERAL}
        return (chars, ANY) if len(chars) and all(k is op.LITERAL for k, _ in value) and len(chars) <= 8 else (None, ANY)
    return None, ANY


def _whole(nodes) -> tuple[set[str] | None, Query]:
    """Exact strings of a sub-expression where it has few, else its query alone."""
    strings: set[str] | None = {""}
    query = ANY
    all_exact = True
    for kind, value in nodes:
        exact, inner = _one(kind, value)
        query = _both(query, inner)
        if exact is not None and len(exact) * len(strings) <= _MOST_STRINGS:
            strings = {a + b for a, b in product(strings, exact)}
            continue
        all_exact = False
        query = _both(query, _of_strings(strings))
        strings = {""} if exact is None else set(exact)
    if all_exact:
        return strings, query
    return None, _both(query, _of_strings(strings))


def trigram_query(pattern: str) -> Query:
    """Alternatives of trigrams, over lowered text, one of which every match of ``pattern`` holds."""
    exact, query = _whole(_parser.parse(pattern))
    return _both(query, _of_strings(exact)) if exact is not None else query


def postings(docs: DataFrame, trigrams: list[str], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Inverted index of these trigrams: ``trigram, doc_id`` for each row whose lowered text holds it."""
    held = F.transform(
        F.array(F.lower(F.col(text))),
        lambda low: F.array_compact(F.array(*[F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in trigrams])),
    )[0]
    return docs.select(F.col(doc_id).alias("doc_id"), F.explode(held).alias("trigram"))


def candidates(index: DataFrame, queries: dict[int, Query]) -> DataFrame:
    """``doc_id, rules``: rows whose postings satisfy a rule's query, with those rules.

    The clauses are a small table of constants. A posting list meets only
    counts: a clause holds where as many of its trigrams are found as it has.
    """
    clauses = [
        (rule, n, trigram, len(parts)) for rule, query in queries.items() for n, parts in enumerate(sorted(map(sorted, query))) for trigram in parts
    ]
    wanted = index.sparkSession.createDataFrame(clauses, "rule int, clause int, trigram string, need int")
    return (
        index.distinct().join(F.broadcast(wanted), "trigram").groupBy("doc_id", "rule", "clause", "need").count()
        .filter(F.col("count") == F.col("need")).groupBy("doc_id").agg(F.collect_set("rule").alias("rules"))
    )


def _found(text: Column, number: int, rule: Rule) -> Column:
    """Matches of a rule from left to right, each with the length before it since the last one."""
    every, around = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), F.split(text, rule.pattern, -1)
    asked = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else every
    zipped = F.arrays_zip(every.alias("m"), around.alias("gap"), asked.alias("g"))
    zipped = F.filter(zipped, lambda z: z["m"].isNotNull())
    return F.transform(zipped, lambda z, i: F.struct(
        F.lit(number).alias("kind"), i.alias("i"), F.length(z["gap"]).alias("gap"), F.length(z["m"]).alias("size"),
        (F.length(z["g"]) >= rule.least).alias("good"),
    ))


def _shape(pattern: str, least: int) -> str:
    """A character class repeated is a maximal run, so its least length may stand in the pattern."""
    return f"{pattern[:-1]}{{{least},}}" if pattern.startswith("[") and pattern.endswith("]+") and pattern.count("]") == 1 else pattern


def spans(
    docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Secrets of every row: ``doc_id, spans``, an array of ``(start, kind, end)`` in code points.

    ``kind`` is the number of the rule; matches of one rule are the leftmost
    ones that do not overlap, and those too short for the rule are left out.
    Spans are sorted by start, then rule. Null and empty texts have none.
    Repeated rows and null ids give a row each; an empty table gives none;
    other columns are not looked at. Texts of any length are searched whole,
    each as one value.
    """
    rules = tuple(Rule(r.kind, _shape(r.pattern, r.least), r.group, r.least) for r in rules)
    queries = {n: trigram_query(r.pattern) for n, r in enumerate(rules)}
    full = [n for n, q in queries.items() if frozenset() in q]
    behind = {n: q for n, q in queries.items() if n not in full}
    body = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(F.col(doc_id).alias("doc_id"), body.alias("text"))
    trigrams = sorted({t for q in behind.values() for clause in q for t in clause})
    index = stored(postings(base, trigrams)) if trigrams else None
    keyed = base.withColumn("row", F.xxhash64("text"))
    if index is None:
        opened = keyed.withColumn("rules", F.array().cast("array<int>"))
    else:
        maybe = candidates(index, behind).withColumnRenamed("doc_id", "_doc")
        opened = keyed.join(maybe, F.col("doc_id").eqNullSafe(F.col("_doc")), "left").drop("_doc")
    none = F.array().cast("array<struct<kind:int,i:int,gap:int,size:int,good:boolean>>")

    def run(n: int, rule: Rule) -> Column:
        open_ = F.lit(True) if n in full else F.array_contains("rules", n)
        return F.when(open_ & F.col("text").rlike(rule.pattern), _found(F.col("text"), n, rule)).otherwise(none)

    each = opened.select("doc_id", "row", F.inline(F.concat(*[run(n, r) for n, r in enumerate(rules)]))).distinct()
    upto = W.partitionBy("doc_id", "row", "kind").orderBy("i")
    placed = each.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(upto)).filter("good")
    listed = placed.groupBy("doc_id", "row").agg(
        F.array_sort(F.collect_list(F.struct((F.col("end") - F.col("size")).alias("start"), "kind", "end"))).alias("spans")
    ).select(F.col("doc_id").alias("_doc"), F.col("row").alias("_row"), "spans")
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("row") == F.col("_row"))
    empty = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    return keyed.select("doc_id", "row").join(listed, same, "left").select("doc_id", F.coalesce("spans", empty).alias("spans"))


def digest(found: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, base: int = len(BASE)) -> DataFrame:
    """Counts of the first ``base`` rules, the digest of their spans, and all spans as text."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    shown = lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    text = lambda xs: F.array_join(F.transform(xs, shown), ",")
    count = lambda n: F.size(F.filter("spans", lambda s: s["kind"] == n)).cast("long")
    return found.select(
        "doc_id", *[count(n).alias(f"n_{r.kind}") for n, r in enumerate(rules[:base])],
        F.sha2(text(F.filter("spans", lambda s: s["kind"] < base)), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"),
    )
