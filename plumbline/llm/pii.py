"""Personal data: fixed patterns, and identifiers found by bootstrapping from context.

Fixed patterns find e-mail addresses, IP addresses, card and phone numbers.  These are the
seeds.  The words around seeds are lexical patterns; other tokens that hold a digit or an
``@``, and neighbouring tokens of digits as one, are instances if they stand in such a
context.  What contradicts a pattern is instances of other kinds, and others that do not look
like its kind; what is merely unseen does not.  Without a word in the context all others
contradict.  An instance is scored by the chance that not all its patterns err.  Instances
of high score become spans of the kind, and seeds of further patterns, until a round adds
none.

Only DataFrame functions are used.  Positions come from the lengths of what ``split``
leaves and ``regexp_extract_all`` takes.  The regular expressions are the plain ones made
possessive and tied to the start of a run, so that long runs take linear time and loops
need no stack; matches are the same.

Cases: a null text is empty and has no spans; repeated rows and null ids each get their row;
spans of different kinds may overlap; without seeds nothing is induced; an empty table
gives an empty result; extra columns are ignored by ``find`` and kept by ``redact``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.session import cut_lineage

KINDS = ("email", "ip", "card", "phone")
# The contract's patterns.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PART = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: A run of neighbouring tokens of digits, brackets, dots and hyphens: punctuation at a token's
#: end, and a plus, end the run; an IP address stands by itself.
_DIGITS = r"[(\[]*+[0-9][()\[\]0-9.-]*+(?=[,;:!?}>\"']*+(?:\s|\z))"
_QUAD = r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++(?![()\[\]0-9-])"
_RUN = rf"[{{<\"']*+\+?+(?!{_QUAD}){_DIGITS}(?:(?<!\.)\x20++(?:-\x20++)?+(?!{_QUAD}){_DIGITS})++"
#: Such a run, or a token with a digit or an @, and what is cut from its ends; a bracket stays
#: that closes before more digits.
_TOKEN = rf"(?<!\S)(?:{_RUN}|[^\s0-9@]*+[0-9@]\S*+)"
_HEAD = r"^(?:[\[{<\"']|\((?![0-9\x20.-]*+\)[\x20.-]*+[0-9]))*+"
_TAIL = r"(?<![.,;:!?)\]}>\"'])[.,;:!?)\]}>\"']++$"
_SPAN = "struct<kind:int,start:int,end:int>"

#: Distinct seeds that a pattern needs, and the scores that patterns and instances need.
SUPPORT, PATTERN_SCORE, INSTANCE_SCORE = 4, 0.7, 0.8
#: A found instance has at least so many characters.
LEAST_CHARS = 6


def _starts(lengths: Column, first: Column) -> Column:
    """``first`` plus the sum of the lengths before each; in slices, as appending to a
    long array copies it."""
    def running(sizes: Column, at: Column) -> Column:
        return F.aggregate(
            sizes, F.struct(at.cast("int").alias("at"), F.expr("CAST(array() AS array<int>)").alias("out")),
            lambda s, x: F.struct((s["at"] + x).cast("int").alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")),
            lambda s: s["out"])

    slices = F.when(F.size(lengths) > 0, F.transform(
        F.sequence(F.lit(0), ((F.size(lengths) - 1) / 256).cast("int")),
        lambda k: F.slice(lengths, k * 256 + 1, 256))).otherwise(F.expr("CAST(array() AS array<array<int>>)"))
    sums = F.transform(slices, lambda s: F.aggregate(s, F.lit(0), lambda a, x: a + x))
    return F.flatten(F.zip_with(slices, running(sums, first), running))


def _matches(text: Column, pattern: str) -> Column:
    """Array of (text, start, end, what stands between the match before and this one)."""
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.slice(between, 1, F.size(found))
    ends = _starts(F.zip_with(F.transform(gaps, F.length), F.transform(found, F.length), lambda g, m: g + m), F.lit(0))
    rows = F.zip_with(F.arrays_zip(found.alias("m"), gaps.alias("g")), ends, lambda x, at: F.struct(
        x["m"].alias("text"), (at + F.length(x["g"])).alias("start"),
        (at + F.length(x["g"]) + F.length(x["m"])).alias("end"), x["g"].alias("before")))
    # What follows a match is the start of the next gap.
    return F.zip_with(rows, F.slice(F.concat(between, F.array(F.lit(""))), 2, F.size(found)), lambda x, after: F.struct(
        x["text"].alias("text"), x["start"].alias("start"), x["end"].alias("end"),
        _context(x["before"], after).alias("contexts")))


def _context(before: Column, after: Column) -> Column:
    """Lexical patterns: the two words before, and the word before with the one after.
    Words are looked for within 80 characters; a mention's own edge counts as a word."""
    left = F.split(F.lower(F.trim(F.right(F.concat(F.lit("# "), before), F.lit(80)))), r"\s+")
    right = F.split(F.lower(F.trim(F.concat(F.left(after, F.lit(80)), F.lit(" #")))), r"\s+")
    return F.array(
        F.concat(F.array_join(F.slice(F.concat(F.array(F.lit("#")), left), -2, 2), " "), F.lit(" _")),
        F.concat(F.element_at(left, -1), F.lit(" _ "), F.element_at(right, 1)))


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda total, i: total + (
        F.when(i % 2 == 1, F.substring(back, i, F.lit(1)).cast("int"))
        .otherwise(F.translate(F.substring(back, i, F.lit(1)), "0123456789", "0246813579").cast("int")))) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        return F.length(_digits(match)).between(16, 19) & _luhn(_digits(match))
    if kind == "phone":
        return F.length(_digits(match)).between(8, 15)
    return F.lit(True)


def _like(kind: str, text: Column) -> Column:
    """Whether an unseen instance has the shape of the kind, written in another way."""
    digits = F.length(_digits(text))
    if kind == "email":
        return text.rlike("[a-z]") & text.rlike(r"@|[(\[{<]at[)\]}>]|[a-z0-9]\.[a-z]")
    if kind == "ip":
        return text.rlike(r"^[0-9]++(?:[.-][0-9]++){3}$") | text.rlike(r"^[0-9a-f:]*+:[0-9a-f]*+:[0-9a-f:.]*+$")
    if kind == "card":
        return text.rlike(r"^[0-9\x20./-]++$") & digits.between(12, 19)
    return text.rlike(r"^[()\[\]0-9+\x20./-]++$") & digits.between(7, 15)


_NONE = "CAST(array() AS array<struct<text:string,start:int,end:int,contexts:array<string>>>)"
_CAN = {"email": lambda t: t.contains("@"), "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
        "card": lambda t: t.rlike(r"[0-9][\x20-]?[0-9]"), "phone": lambda t: t.contains("+")}


def _scanned(docs: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Each row's matches of each kind and its other tokens, stored under a row number."""
    text = F.coalesce(F.col(text_col), F.lit(""))

    def fixed(kind: str) -> Column:
        found = F.filter(_matches(F.col("_text"), PATTERNS[kind]), lambda m: _valid(kind, m["text"]))
        return F.when(_CAN[kind](F.col("_text")), found).otherwise(F.expr(_NONE)).alias(f"_{kind}")

    def spans(number: int, kind: str) -> Column:
        return F.transform(f"_{kind}", lambda m: F.struct(
            F.lit(number).alias("kind"), m["start"].alias("start"), m["end"].alias("end")))

    def instances(number: int, kind: str) -> Column:
        return F.transform(f"_{kind}", lambda m: F.struct(
            F.lit(number).alias("kind"), F.lower(m["text"]).alias("text"), m["contexts"].alias("contexts")))

    tokens = F.when(F.col("_text").rlike("[0-9@]"), _matches(F.col("_text"), _TOKEN)).otherwise(F.expr(_NONE))
    kept = F.struct(*[F.col(f"`{c}`") for c in keep] or [F.lit(0)])  # their names meet no others
    rows = docs.select(kept.alias("_kept"), F.col(id_col).alias("_id"), text.alias("_text")) \
        .select("_kept", "_id", *map(fixed, KINDS), tokens.alias("_tokens"))
    seeds = F.flatten(F.array(*[spans(n, k) for n, k in enumerate(KINDS)]))

    def trimmed(m: Column) -> Column:
        head = F.length(m["text"]) - F.length(F.regexp_replace(m["text"], _HEAD, ""))
        tail = F.length(m["text"]) - F.length(F.regexp_replace(m["text"], _TAIL, ""))
        return F.struct(F.lower(F.regexp_replace(F.regexp_replace(m["text"], _HEAD, ""), _TAIL, "")).alias("text"),
                        (m["start"] + head).alias("start"), (m["end"] - tail).alias("end"),
                        m["contexts"].alias("contexts"))

    others = F.filter(F.transform("_tokens", trimmed), lambda m: (F.length(m["text"]) >= LEAST_CHARS) & ~F.exists(
        "_seeds", lambda s: (s["start"] < m["end"]) & (s["end"] > m["start"])))
    named = F.flatten(F.array(*[instances(n, k) for n, k in enumerate(KINDS)]))
    return cut_lineage(
        rows.withColumn("_seeds", seeds)
        .select("_kept", "_id", F.monotonically_increasing_id().alias("_row"), "_seeds",
                named.alias("_named"), others.alias("_others")))


def _discover(scanned: DataFrame) -> DataFrame:
    """``_row`` and ``_found``, the spans of instances that the patterns bring up."""
    seeds = scanned.select(F.explode("_named").alias("m")) \
        .select(F.explode("m.contexts").alias("pattern"), F.col("m.text").alias("instance"), F.col("m.kind").alias("kind"))
    mentions = scanned.select("_row", F.explode("_others").alias("m"))
    others = mentions.select(F.explode("m.contexts").alias("pattern"), F.col("m.text").alias("instance"))
    seeds = cut_lineage(seeds.groupBy("pattern", "kind").agg(F.countDistinct("instance").alias("seeds")))
    graph = cut_lineage(others.distinct())
    known = None
    while True:
        fresh = cut_lineage(_round(seeds, graph, known))
        known = fresh if known is None else known.unionByName(fresh)
        if fresh.isEmpty():
            break
    spans = mentions.join(known, F.col("m.text") == F.col("instance"))
    return cut_lineage(spans.groupBy("_row").agg(F.collect_list(F.struct(
        F.col("kind").cast("int").alias("kind"), F.col("m.start").cast("int").alias("start"),
        F.col("m.end").cast("int").alias("end"))).alias("_found")))


def _round(seeds: DataFrame, graph: DataFrame, known: DataFrame | None) -> DataFrame:
    """``instance`` and ``kind`` of what the patterns bring up besides ``known``, whose
    mentions count as seeds."""
    if known is not None:
        gained = graph.join(known, "instance").groupBy("pattern", "kind").agg(F.count("*").alias("seeds"))
        seeds = seeds.unionByName(gained)
        graph = graph.join(known, "instance", "left_anti")
    counts = seeds.groupBy("pattern").agg(F.array(*[
        F.coalesce(F.sum(F.when(F.col("kind") == n, F.col("seeds"))), F.lit(0)) for n in range(len(KINDS))]).alias("seeds")) \
        .where(F.array_max("seeds") >= SUPPORT)
    # Only contexts of enough seeds can become patterns; the graph is what they touch.
    counts = cut_lineage(counts)
    graph = cut_lineage(graph.join(counts.select("pattern"), "pattern", "left_semi"))
    empty = F.col("pattern").isin("# # _", "# _ #")
    against = graph.groupBy("pattern").agg(F.array(*[
        F.count(F.when(empty | ~_like(k, F.col("instance")), 1)) for k in KINDS]).alias("against"))
    good = counts.join(against, "pattern", "left") \
        .withColumn("against", F.coalesce("against", F.array(*[F.lit(0).cast("long")] * len(KINDS)))) \
        .withColumn("all", F.aggregate("seeds", F.lit(0).cast("long"), lambda n, x: n + x)) \
        .select("pattern", "all", F.posexplode(F.arrays_zip("seeds", "against")).alias("kind", "n")) \
        .where(F.col("n.seeds") >= SUPPORT) \
        .select("pattern", "kind", (F.col("n.seeds") / (F.col("all") + F.col("n.against") + 1)).alias("score")) \
        .where(F.col("score") >= PATTERN_SCORE)
    scores = graph.join(good, "pattern").groupBy("instance", "kind") \
        .agg((1 - F.exp(F.sum(F.log(1 - F.least(F.col("score"), F.lit(0.999)))))).alias("score"))
    return scores.where(F.col("score") >= INSTANCE_SCORE).groupBy("instance") \
        .agg(F.max(F.struct(F.col("score"), (-F.col("kind")).alias("minus"))).alias("b")) \
        .select(F.col("instance"), (-F.col("b.minus")).alias("kind"))


def _written(spans: Column) -> Column:
    """kind:start:end, comma-joined, by kind as listed, then start."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(kind: int) -> Column:
    return F.size(F.filter("_seeds", lambda s: s["kind"] == kind)).cast("long")


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, the number of fixed spans of each kind, their digest ``base_sha256``,
    all ``spans`` as text, and ``n_found``, the number of those that context brought up."""
    scanned = _scanned(docs, id_col, text_col)
    rows = scanned.select("_row", "_id", "_seeds").join(_discover(scanned), "_row", "left")
    found = F.coalesce("_found", F.expr(f"CAST(array() AS array<{_SPAN}>)"))
    return rows.select(
        F.col("_id").alias(id_col),
        *[_count(n).alias(f"n_{k}") for n, k in enumerate(KINDS)],
        F.sha2(_written(F.col("_seeds")), 256).alias("base_sha256"),
        _written(F.array_sort(F.concat("_seeds", found))).alias("spans"),
        F.size(found).cast("long").alias("n_found"))


def redact(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span in ``text_col`` replaced by its kind, such as ``<email>``.
    Spans that overlap become one, named by the first."""
    columns = docs.columns
    scanned = _scanned(docs, id_col, text_col, tuple(columns))
    rows = scanned.drop("_named", "_others").join(_discover(scanned), "_row", "left")
    spans = F.array_sort(F.transform(
        F.concat("_seeds", F.coalesce("_found", F.expr(f"CAST(array() AS array<{_SPAN}>)"))),
        lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    names = F.array(*[F.lit(f"<{k}>") for k in KINDS])
    text = F.col(f"_kept.`{text_col}`")
    clean = F.aggregate(
        spans, F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<string>)").alias("out")),
        lambda s, x: F.when(x["start"] < s["at"], F.struct(F.greatest(s["at"], x["end"]).alias("at"), s["out"].alias("out")))
        .otherwise(F.struct(x["end"].alias("at"), F.concat(s["out"], F.array(
            F.substring(text, s["at"] + 1, x["start"] - s["at"]), F.get(names, x["kind"]))).alias("out"))),
        lambda s: F.concat(F.array_join(s["out"], ""), F.substring(text, s["at"] + 1, F.length(text))))
    return rows.withColumn("_clean", F.when(F.size(spans) > 0, clean).otherwise(text)).select(
        *[F.col("_clean").alias(c) if c == text_col else F.col(f"_kept.`{c}`") for c in columns])
