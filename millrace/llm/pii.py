"""Personal data and the terms that give it away: information-theoretic sanitisation.

Emails, IPv4 addresses, card numbers and phone numbers are found by pattern. Each distinct
value is a protected entity. The words within reach of its occurrences form its context; with
c(t) the occurrences of a term in the whole corpus, c(t, e) those in e's contexts, C(e) all
words in e's contexts and N all words, a term's disclosure of e is

    log2(c(t, e) N / (c(t) C(e))) / log2(N / C(e)),

its pointwise mutual information over the most a term can have (1: it occurs with e alone).
Evidence weighs in smoothly: with n different contexts that hold both, the disclosure counts
for n / (n + 1) of itself, so a term met once with e is marked if it occurs nowhere else. As
most values are seen once or twice, the values of one domain, network, card issuer or block
of phone numbers are also a protected entity together, and what discloses that is marked
beside each of them. Every pair of entity and term is judged; those at or over the threshold
are marked. If the terms that share the marked one's first letters disclose less than the
threshold, the term is generalised to those letters, otherwise removed. Everything runs as
built-in functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import materialize

#: The base kinds (fixed values), written without repeated groups, over which Java's matcher recurses.
#: Look-behinds at the front only keep a failed run from being tried at each of its characters.
PATTERNS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9-](?:[A-Za-z0-9.-](?<!\.\.))*(?<!\.)",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    # [0-9]([\x20-]?[0-9])+
    "card": r"[0-9](?:[\x200-9-](?<![\x20-]{2}))*[0-9]",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a kind to be looked for.
PROBES = {"email": "@", "ip": r"[0-9]\.[0-9]+\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]"}
KINDS = tuple(PATTERNS)
DISCLOSURE = 0.5
#: Characters on either side of an occurrence that are its context.
REACH = 80
PREFIX = 3
#: A word of its own: no part of an address, a number or a longer name.
_WORD = r"(?<![\p{L}\p{N}@._%+-])\p{L}{3,}(?![\p{L}\p{N}@_%+-]|\.[\p{L}\p{N}])"
#: Code points of the blocks from which contexts are cut, and the fewest numbers that a running sum takes at once.
BLOCK, AT_ONCE = 1024, 64
#: Tasks that share the rows of one key in a join.
SALTS = 16


def _luhn(digits: Column) -> Column:
    """Sum of digits, every second one from the right doubled (9 taken off above 9), divides by ten."""
    at = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), d.cast("int") + 1)))
    return F.aggregate(at, F.lit(0), lambda s, x: s + x) % 10 == 0


def _passes(kind: str, found: Column) -> Column:
    digits = F.regexp_replace(found, "[^0-9]", "")
    n = F.length(digits)
    if kind == "ip":
        part = lambda p: F.length(F.ltrim(p, F.lit("0"))) <= 3
        return F.forall(F.split(found, r"\."), lambda p: part(p) & (F.when(part(p), F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0))).otherwise(256) <= 255))
    if kind == "card":
        return F.when((n >= 13) & (n <= 19), _luhn(digits)).otherwise(False)
    return (n >= 9) & (n <= 15) if kind == "phone" else F.lit(True)


def _passing(kind: str) -> Callable[[Column], Column]:
    return lambda x: _passes(kind, x["value"])


def _named(kind: str) -> Callable[[Column], Column]:
    return lambda x: F.struct(F.lit(kind).alias("kind"), x["value"].alias("value"), x["start"].alias("start"), x["end"].alias("end"))


def _of(kind: str) -> Callable[[Column], Column]:
    return lambda x: x["kind"] == kind


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f's lambdas use it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _summed(numbers: Column) -> Column:
    """(sum, running sums) of an array by one pass; a list grows by copies, so it must be short."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(numbers, start, lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["out"], F.array(s["at"] + n)).alias("out")))


def _running(numbers: Column) -> Column:
    """Running sums of an array of any length: in blocks of about its root, whose own sums are then added up."""

    def blocked(x: Column) -> Column:
        size = F.greatest(F.lit(AT_ONCE), F.ceil(F.sqrt(F.size(x))).cast("int"))
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / size).cast("int")), lambda k: _summed(F.slice(x, k * size + 1, size)))
        starts = lambda b: _summed(F.transform(b, lambda y: y["at"]))["out"]
        return _let(blocks, lambda b: F.flatten(F.zip_with(b, starts(b), lambda own, end: F.transform(own["out"], lambda v: v + end - own["at"]))))

    return _let(numbers, lambda x: F.when(F.size(x) > 0, blocked(x)).otherwise(F.array().cast("array<int>")))


def _located(text: Column, pattern: str, probe: Column) -> Column:
    """Array of (value, start, end) of all leftmost, non-overlapping matches, in code points.

    Lengths of the texts between matches and of the matches themselves, both in order, sum up to the offsets.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)

    def spans(f: Column) -> Column:
        ends = _running(F.zip_with(f, F.slice(between, F.lit(1), F.size(f)), lambda m, b: F.length(m) + F.length(b)))
        return F.zip_with(f, ends, lambda m, end: F.struct(m.alias("value"), (end - F.length(m)).alias("start"), end.alias("end")))

    none = F.array().cast("array<struct<value:string,start:int,end:int>>")
    return F.when(probe, _let(found, lambda f: F.when(F.size(f) > 0, spans(f)).otherwise(none))).otherwise(none)


def _cut(blocks: Column, start: Column, length: Column) -> Column:
    """Code points of the text that was cut into blocks; no more than BLOCK of them, so two blocks hold them."""
    first = F.floor(start / BLOCK).cast("int")
    two = F.concat(F.coalesce(F.get(blocks, first), F.lit("")), F.coalesce(F.get(blocks, first + 1), F.lit("")))
    return F.substring(two, start - first * BLOCK + 1, length)


def _base(docs: DataFrame, carried: list[str]) -> DataFrame:
    """Columns ``carried``, a row number and all base spans of each text with what is around them."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(*[F.col(c).alias(f"c_{c}") for c in carried], text.alias("_text"))
    parts = []
    for kind in KINDS:
        probe = F.col("_text").contains("@") if kind == "email" else F.col("_text").rlike(PROBES[kind])
        good = F.filter(_located(F.col("_text"), PATTERNS[kind], probe), _passing(kind))
        parts.append(F.transform(good, _named(kind)))

    def around(x: Column, blocks: Column) -> Column:
        """The span with the whole words near it; ``before`` ends where the span starts, ``after`` starts at its end."""
        before = _cut(blocks, F.greatest(x["start"] - REACH, F.lit(0)), F.least(x["start"], F.lit(REACH)))
        after = _cut(blocks, x["end"], F.lit(REACH))
        before = F.when(x["start"] > REACH, F.regexp_replace(before, r"^\p{L}+", "")).otherwise(before)
        after = F.when(F.length(after) == REACH, F.regexp_replace(after, r"\p{L}+$", "")).otherwise(after)
        return F.struct(x["kind"].alias("kind"), x["value"].alias("value"), x["start"].alias("start"), x["end"].alias("end"), before.alias("before"), after.alias("after"))

    def placed(spans: Column) -> Column:
        blocks = F.regexp_extract_all(F.col("_text"), F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
        return _let(blocks, lambda b: F.transform(spans, lambda x: around(x, b)))

    none = F.array().cast("array<struct<kind:string,value:string,start:int,end:int,before:string,after:string>>")
    spans = _let(F.concat(*parts), lambda x: F.when(F.size(x) > 0, placed(x)).otherwise(none))
    return materialize(rows.withColumn("_row", F.monotonically_increasing_id()).withColumn("_spans", spans).drop("_text"), "spans")


def _contexts(base: DataFrame) -> DataFrame:
    """(_row, entity, context, term, start, end): the words around each occurrence of an entity.

    Each word comes twice: for the value itself and for the pool of values that it belongs to.
    """
    span = base.select("_row", F.explode("_spans").alias("x")).select("_row", "x.*")
    digits = F.regexp_replace("value", "[^0-9]", "")
    value = F.when(F.col("kind") == "email", F.lower("value")).when(F.col("kind") == "ip", F.col("value")).otherwise(digits)
    pool = F.when(F.col("kind") == "email", F.substring_index(F.lower("value"), "@", -1)).when(F.col("kind") == "ip", F.substring_index("value", ".", 3)).when(F.col("kind") == "card", F.left(digits, F.lit(6))).otherwise(F.left(digits, F.length(digits) - 4))
    entities = F.array(F.concat_ws(":", "kind", value), F.concat_ws(":", F.lit("pool"), "kind", pool))
    words = lambda part, at: F.transform(_located(F.col(part), _WORD, F.lit(True)), lambda w: F.struct(F.lower(w["value"]).alias("term"), (w["start"] + at).alias("start"), (w["end"] + at).alias("end")))
    near = F.concat(words("before", F.col("start") - F.length("before")), words("after", F.col("end")))
    held = span.select("_row", entities.alias("entities"), F.xxhash64("before", "after").alias("context"), F.explode(near).alias("w"))
    return held.select("_row", F.explode("entities").alias("entity"), "context", "w.*")


def _with(rows: DataFrame, side: DataFrame, key: str, by: str) -> DataFrame:
    """``rows`` joined with ``side``, which has one row for each key; a frequent key's rows are dealt over several tasks by ``by``."""
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)))
    keys = dealt.select(key, "_salt").distinct().join(side, key)
    return dealt.join(keys, [key, "_salt"]).drop("_salt")


def disclosing_terms(docs: DataFrame, contexts: DataFrame, threshold: float = DISCLOSURE) -> DataFrame:
    """(entity, term, disclosure, action): the terms that give an entity away.

    ``contexts`` are counted over all entities, ``docs`` over all words of all texts; copies
    of one context count once as evidence. Disclosure is weighed by its evidence.
    """
    joint = contexts.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("c_te"), F.count_distinct("context").alias("n_contexts"))
    joint = materialize(joint.withColumn("prefix", F.left("term", F.lit(PREFIX))), "joint")
    word = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(_WORD), F.lit(0))).alias("term"))
    c_t = materialize(word.groupBy("term").agg(F.count(F.lit(1)).alias("c_t")), "words")
    total = float(c_t.agg(F.sum("c_t")).first()[0] or 1)
    c_p = c_t.groupBy(F.left("term", F.lit(PREFIX)).alias("prefix")).agg(F.sum("c_t").alias("c_p"))
    c_e = joint.groupBy("entity").agg(F.sum("c_te").alias("c_e"))
    c_pe = joint.groupBy("entity", "prefix").agg(F.sum("c_te").alias("c_pe"))

    def share(both: str, alone: str) -> Column:
        # Contexts may overlap, so a word can count for an entity more often than it occurs.
        most = F.log2(F.lit(total) / F.col("c_e"))
        own = F.log2(F.least(F.col(both), F.col(alone)) * F.lit(total) / (F.col(alone) * F.col("c_e")))
        return F.when(F.col("c_e") < total, own / most).otherwise(0.0)

    weight = F.col("n_contexts") / (F.col("n_contexts") + 1)
    judged = _with(_with(joint, c_t, "term", "entity"), c_e, "entity", "term").withColumn("disclosure", share("c_te", "c_t") * weight)
    told = judged.where(F.col("disclosure") >= threshold).join(c_p, "prefix").join(c_pe, ["entity", "prefix"])
    action = F.when(share("c_pe", "c_p") < threshold, "generalise").otherwise("remove")
    return told.select("entity", "term", "disclosure", action.alias("action"))


def _all_spans(docs: DataFrame, carried: list[str]) -> DataFrame:
    """``carried`` with base spans and term spans (start, end, action), by row."""
    base = _base(docs, [*carried])
    near = materialize(_contexts(base), "contexts")
    told = materialize(disclosing_terms(docs, near), "terms").select("entity", "term", "action")
    terms = near.join(told, ["entity", "term"]).groupBy("_row", "start", "end").agg(F.max("action").alias("action"))
    terms = terms.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("start", "end", "action"))).alias("_terms"))
    none = F.array().cast("array<struct<start:int,end:int,action:string>>")
    return base.join(terms, "_row", "left").withColumn("_terms", F.coalesce("_terms", none)).select(*[F.col(f"c_{c}").alias(c) for c in carried], F.col("_spans").alias("spans"), F.col("_terms").alias("terms"))


def pii_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and n_term of every document.

    Spans are kind:start:end in code points, by kind (terms last), then start. A null text is
    empty; repeated rows and null ids come back as they came in; extra columns are ignored;
    an empty table gives an empty result. Base spans of different kinds may overlap. A
    document's list of spans is as long as the document allows, no list is cut.
    """
    rows = _all_spans(docs, ["doc_id"])
    text = lambda kind, x: F.concat_ws(":", kind, x["start"].cast("string"), x["end"].cast("string"))
    base = F.array_join(F.transform("spans", lambda x: text(x["kind"], x)), ",")
    every = F.array_join(F.concat(F.transform("spans", lambda x: text(x["kind"], x)), F.transform("terms", lambda x: text(F.lit("term"), x))), ",")
    counts = [F.size(F.filter("spans", _of(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return rows.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), every.alias("spans"), F.size("terms").cast("long").alias("n_term"))


def sanitised(docs: DataFrame) -> DataFrame:
    """doc_id and the text with base spans replaced by their kind, disclosing terms by their first letters and * or by [TERM].

    Of overlapping spans the one that starts first, then the longer, is replaced.
    """
    rows = _all_spans(docs, ["doc_id", "text"])
    one = lambda a, b, c: F.struct(a.alias("start"), (-b).alias("less"), c.alias("by"))
    base = F.transform("spans", lambda x: one(x["start"], x["end"], F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]"))))
    word = lambda x: F.substring(F.col("text"), x["start"] + 1, F.lit(PREFIX))
    term = F.transform("terms", lambda x: one(x["start"], x["end"], F.when(x["action"] == "generalise", F.concat(word(x), F.lit("*"))).otherwise(F.lit("[TERM]"))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(s: Column, x: Column) -> Column:
        kept = F.concat(s["out"], F.substring(F.col("text"), s["at"] + 1, x["start"] - s["at"]), x["by"])
        return F.when(x["start"] >= s["at"], F.struct((-x["less"]).alias("at"), kept.alias("out"))).otherwise(s)

    done = F.aggregate(F.sort_array(F.concat(base, term)), start, step, lambda s: F.concat(s["out"], F.substring(F.col("text"), s["at"] + 1, F.length("text"))))
    return rows.select("doc_id", F.when(F.col("text").isNotNull(), done).alias("text"))
