"""Personal data: base patterns, and contextual extraction bootstrapped from what they find.

Base: leftmost non-overlapping matches of four formats (email, ip, card, phone), each then held
to its rule (parts up to 255, Luhn, number of digits); failing matches are dropped. Secrets
(assigned passwords and tokens, keys by their well-known beginnings) are a fifth kind of seed,
which has columns of its own.

Bootstrapping finds identifiers that the base misses: a phone number that the base's greedy match
ran into the card number behind it, a number without a plus, an address with `[at]`, a key that
nothing names. The base matches are the seeds. Address runs, runs of digit groups that obey a
kind's rule and opaque runs of letters and digits are further instances, which begin without
confidence; their form is free, so contexts and shapes tell them. An instance fills up to three
lexical patterns of its kind: the word before it, the word after it, and its own shape (digits and
letters by class). Spark scores the bipartite graph of patterns and instances in `ROUNDS` rounds:
a pattern's confidence is the mean confidence of its distinct instances, so one that seeds seldom
fill counts for little; an instance's confidence is the chance that not all of its patterns err.
Instances of at least `ACCEPT`, by patterns of at least `RELIABLE` with the support of `SUPPORT`
distinct instances, are accepted and count as support beside the seeds in the next round, so
patterns that only they fill can become trusted. At the end the accepted become spans where no
base span overlaps them and no better one of their own.

The regular expressions are written so that matching is linear in the text: a match can only
begin at the start of a run, which a look-behind states, and repetitions are possessive. Matches
are rows, and positions are running sums over a text's rows in order, so time is linear in them.
Only texts with a digit, an at sign, a bracketed `at`, a `dot` as a word or a credential's name are
searched. The graph is made of hashes and counts.

Edge cases: a null text is empty; documents without findings have zeros, an empty string of
spans and its hash; repeated rows and ids are each answered; a text of any length is searched
whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

KINDS = ("email", "ip", "card", "phone")
#: The place of secrets behind the kinds.
SECRET = 4
_LOCAL = r"A-Za-z0-9._%+\-"
#: The base formats, as linear-time equivalents.
BASE = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"(?<![0-9])[0-9](?:[\x20\-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9\-]+[0-9]",
}
#: An address run: at and dot as signs, in brackets or, together, as words. Its matches need a context to count.
_NAME = r"[A-Za-z0-9\-]++"
_AT, _DOT = r"(?:@|[\[({<]\x20?(?i:at|@)\x20?[\])}>])", r"(?:\.|[\[({<]\x20?(?i:dot|\.)\x20?[\])}>])"
ADDRESS = rf"(?<![{_LOCAL}])[{_LOCAL}]++(?:\x20{{0,2}}{_AT}\x20{{0,2}}{_NAME}(?:\x20?{_DOT}\x20?{_NAME}|\x20(?i:dot)\x20{_NAME})*+|\x20(?i:at)\x20{_NAME}(?:\x20(?i:dot)\x20{_NAME})++)"
_NAMED = r"(?i:password|passwd|pwd|secret|token|api[_\-]?key)[\"']?[\x20]{0,2}[=:][\x20]{0,2}[\"']?"
#: Seeds of secrets: a credential's name with what is assigned to it (the span is the latter), and keys by their public beginnings.
CREDENTIAL = rf"{_NAMED}[^\s\"',;]{{8,}}+|(?<![A-Za-z0-9])(?:A[KS]IA[0-9A-Z]{{16}}(?![A-Za-z0-9])|gh[pousr]_[A-Za-z0-9]{{36,}}+|sk-[A-Za-z0-9_\-]{{20,}}+|xox[abprs]-[A-Za-z0-9\-]{{10,}}+)"
#: A run of letters and digits, some of each.
OPAQUE = r"(?<![A-Za-z0-9])(?=[A-Za-z]*+[0-9])(?=[0-9]*+[A-Za-z])[A-Za-z0-9]{16,}+"
#: Everything located in a text, by number: the kinds, the seeds of secrets, then what a context must tell.
LOCATED = [*BASE.values(), CREDENTIAL, ADDRESS, OPAQUE, "[0-9]++"]
ADDRESSES, OPAQUES, GROUPS = 5, 6, 7
#: A run has at most so many digit groups, of at most so many digits together, and 1 to 3 signs between them.
RUN_GROUPS, RUN_DIGITS, BETWEEN = 15, 19, r"^[^\p{L}0-9\n]{1,3}$"
#: What a text needs for any of the formats above to match.
SEARCHED = rf"[0-9@]|{_AT}|\x20(?i:dot)\x20|{_NAMED}"
ROUNDS = 3
ACCEPT, SUPPORT, RELIABLE = 0.8, 3, 0.5
#: Characters on either side in which a neighbouring word is looked for.
REACH = 48


def _matches(k: int, text: Column) -> Column:
    """The matches of a located pattern: its number k, their order i, the gap before, the value, and what is near on either side."""
    values = F.regexp_extract_all(text, F.lit(LOCATED[k]), F.lit(0))
    gaps = F.split(text, LOCATED[k], -1)
    zipped = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(values)).alias("before"), values.alias("value"), F.slice(gaps, F.lit(2), F.size(values)).alias("after"))
    return F.transform(
        zipped,
        lambda x, i: F.struct(
            F.lit(k).alias("k"), i.alias("i"), F.length(x["before"]).alias("gap"), x["value"].alias("value"),
            F.right(x["before"], F.lit(REACH)).alias("left"), F.left(x["after"], F.lit(REACH)).alias("right"),
        ),
    )


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    value = lambda i: F.substring(digits, n - i, F.lit(1)).cast("int")  # noqa: E731  i-th from the right
    doubled = lambda i: F.when(i % 2 == 1, F.when(value(i) > 4, value(i) * 2 - 9).otherwise(value(i) * 2)).otherwise(value(i))
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda acc, i: acc + doubled(i)) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.forall(F.regexp_extract_all(value, F.lit("[0-9]+"), F.lit(0)), lambda p: (F.length(part(p)) <= 3) & (F.substring(part(p), 1, 3).cast("int") <= 255))
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def located(docs: DataFrame) -> DataFrame:
    """row, doc_id and all matches of a document; no text."""
    text = F.col("text")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.when(text.rlike(SEARCHED), text).alias("text"))
    none = F.array().cast("array<struct<k:int,i:int,gap:int,value:string,left:string,right:string>>")
    found = F.concat(*[_matches(k, text) for k in range(len(LOCATED))])
    return rows.select("row", "doc_id", F.when(text.isNotNull(), found).otherwise(none).alias("m"))


def _before() -> Column:
    """The last word near before a match, null where there is none."""
    return F.nullif(F.regexp_extract(F.lower("left"), r"(\p{L}++)[^\p{L}]*$", 1), F.lit(""))


def _after() -> Column:
    return F.nullif(F.regexp_extract(F.lower("right"), r"^[^\p{L}]*+(\p{L}++)", 1), F.lit(""))


def _shape(kind: Column, value: Column) -> Column:
    """Letters and digits by class; of an opaque secret only the classes that occur and the length."""
    classes = F.concat_ws("", *[F.when(value.rlike(f"[{c}]"), F.lit(c)) for c in ("A-F", "G-Z", "a-f", "g-z")], F.length(value).cast("string"))
    return F.when(kind == SECRET, classes).otherwise(F.regexp_replace(F.regexp_replace(value, "[A-Za-z]+", "a"), "[0-9]", "9"))


def _slim(rows: DataFrame, seed: bool) -> DataFrame:
    """Spans with hashes for value and patterns."""
    kind = F.col("kind")
    contexts = F.array_compact(F.array(F.concat(F.lit("<"), "before"), F.concat(F.lit(">"), "after"), F.concat(F.lit("="), _shape(kind, F.col("value")))))
    return rows.select(
        "row", F.lit(seed).alias("seed"), "kind", "start", "end",
        F.xxhash64("kind", "value").alias("instance"), F.transform(contexts, lambda c: F.xxhash64(kind, c)).alias("patterns"),
    )


def _digit_runs(groups: DataFrame) -> DataFrame:
    """Runs of whole digit groups that a card, an address or a phone number can be, and that no base span meets.

    A run begins at any group and ends at any of the next 14, so numbers that stand side by side
    come apart. A plus before a phone number belongs to it, and so does a bracket that closes within it.
    """
    ordered = Window.partitionBy("row").orderBy("start")
    upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    onwards = Window.partitionBy("row").orderBy(F.col("start").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # backwards: Spark computes such a frame in one pass
    near = lambda w, at: F.when(w.isNotNull(), F.struct(w.alias("w"), F.col(at).alias("at")))
    one = F.struct("start", "end", F.when((F.col("gap") <= 3) & ~F.col("met"), F.col("left")).alias("sign"), F.left("value", F.lit(RUN_DIGITS + 1)).alias("digits"), "next")
    rows = groups.withColumn("previous", F.last(near(_before(), "start"), ignorenulls=True).over(upto)).withColumn("next", F.last(near(_after(), "end"), ignorenulls=True).over(onwards))
    rows = rows.withColumn("g", F.collect_list(one).over(ordered.rowsBetween(Window.currentRow, RUN_GROUPS - 1)))
    rows = rows.filter(~F.col("met") & (F.length("value") <= RUN_DIGITS)).select("row", "start", "previous", F.regexp_extract(F.right("left", F.lit(2)), r"\+?\(?$", 0).alias("lead"), "g")

    def longer(acc: Column, x: Column) -> Column:
        first = F.size(acc["runs"]) == 0
        n = acc["n"] + F.length(x["digits"])
        goes = acc["open"] & (n <= RUN_DIGITS) & (first | F.coalesce(x["sign"].rlike(BETWEEN), F.lit(False)))
        core = F.when(first, x["digits"]).otherwise(F.concat(acc["core"], x["sign"], x["digits"]))
        run = F.struct(core.alias("core"), n.alias("n"), x["end"].alias("end"), x["next"].alias("next"))
        return F.struct(F.when(goes, core).alias("core"), n.cast("int").alias("n"), goes.alias("open"), F.when(goes, F.concat(acc["runs"], F.array(run))).otherwise(acc["runs"]).alias("runs"))

    empty = F.array().cast("array<struct<core:string,n:int,end:int,next:struct<w:string,at:int>>>")
    start = F.struct(F.lit(None).cast("string").alias("core"), F.lit(0).alias("n"), F.lit(True).alias("open"), empty.alias("runs"))
    runs = rows.select("row", "start", "previous", "lead", F.posexplode(F.aggregate("g", start, longer, lambda acc: acc["runs"])).alias("groups", "r"))
    lead = F.when(F.contains("r.core", F.lit(")")), F.col("lead")).otherwise(F.regexp_extract("lead", r"\+$", 0))
    core, n = F.col("r.core"), F.col("r.n")
    kinds = F.array_compact(
        F.array(
            F.when((F.col("groups") == 3) & (n <= 12) & _valid("ip", core), F.struct(F.lit(1).alias("kind"), F.lit("").alias("lead"))),
            F.when((n >= 16) & _valid("card", core), F.struct(F.lit(2).alias("kind"), F.lit("").alias("lead"))),
            F.when(n.between(8, 15), F.struct(F.lit(3).alias("kind"), lead.alias("lead"))),
        )
    )
    spans = runs.select("row", "start", "r", "previous", F.explode(kinds).alias("k"))
    word = lambda c, far: F.when(far <= REACH, F.col(f"{c}.w"))
    return spans.select(
        "row", "k.kind", (F.col("start") - F.length("k.lead")).alias("start"), F.col("r.end").alias("end"), F.concat("k.lead", "r.core").alias("value"),
        word("previous", F.col("start") - F.col("previous.at")).alias("before"), word("r.next", F.col("r.next.at") - F.col("r.end")).alias("after"),
    )


def spans_of(rows: DataFrame) -> DataFrame:
    """row, seed, kind, start, end (code points), instance and patterns of every valid base match, secret and free candidate."""
    flat = rows.select("row", F.explode("m").alias("m")).select("row", "m.*").repartition("row")
    inner = Window.partitionBy("row", "k").orderBy("i")
    ends = F.sum(F.col("gap") + F.length("value")).over(inner.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    flat = flat.withColumn("end", ends.cast("int")).withColumn("kind", F.col("k"))
    flat = flat.withColumn("value", F.when(F.col("k") == SECRET, F.regexp_replace("value", f"^{_NAMED}", "")).otherwise(F.col("value"))).withColumn("start", F.col("end") - F.length("value"))
    rule = F.lit(True)
    for kind in ("ip", "card", "phone"):
        rule = F.when(F.col("k") == KINDS.index(kind), _valid(kind, F.col("value"))).otherwise(rule)
    flat = flat.withColumn("base", F.col("k") <= SECRET).filter(~F.col("base") | rule)
    ordered = Window.partitionBy("row").orderBy("start", F.col("base").desc(), "k", "end")
    reach = F.max(F.when(F.col("base"), F.col("end"))).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    backwards = Window.partitionBy("row").orderBy(F.col("start").desc(), "base", F.col("k").desc(), F.col("end").desc())
    following = F.min(F.when(F.col("base"), F.col("start"))).over(backwards.rowsBetween(Window.unboundedPreceding, -1))
    flat = flat.withColumn("met", F.coalesce(reach > F.col("start"), F.lit(False)) | F.coalesce(following < F.col("end"), F.lit(False)))
    flat = written(flat.select("row", "k", "kind", "base", "gap", "value", "left", "right", "start", "end", "met"))
    words = flat.withColumn("before", _before()).withColumn("after", _after())
    free = words.filter(~F.col("met"))
    loose = [
        free.filter(F.col("k") == ADDRESSES).withColumn("kind", F.lit(0)),
        free.filter(F.col("k") == OPAQUES).withColumn("kind", F.lit(SECRET)),
        _digit_runs(flat.filter(F.col("k") == GROUPS)),
    ]
    out = _slim(words.filter("base"), True)
    for part in loose:
        out = out.unionByName(_slim(part.select("row", "kind", "start", "end", "value", "before", "after"), False))
    return out


def scored_patterns(spans: DataFrame, rounds: int = ROUNDS, accept: float = ACCEPT, support: int = SUPPORT) -> DataFrame:
    """pattern, confidence and support (its distinct seeds and accepted instances) after the rounds of mutual scoring."""
    edges = spans.select("instance", F.explode("patterns").alias("pattern"), F.col("seed").cast("double").alias("seed"))
    graph = written(edges.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")))
    patterns = graph.groupBy("pattern").agg(F.avg("seed").alias("confidence"), F.sum("seed").alias("seeds"), F.sum("seed").alias("support"), F.count(F.lit(1)).alias("n"))
    for _ in range(rounds - 1):
        patterns = written(patterns)
        weighted = graph.join(patterns, "pattern").filter("seed = 0")
        beliefs = weighted.groupBy("instance").agg(_belief(_weight()).alias("belief"))
        accepted = _accepted(spans, patterns.select("pattern", _weight().alias("confidence"), "support"), accept, support)
        instances = beliefs.join(accepted.select("instance", F.lit(1.0).alias("one")).distinct(), "instance", "left")
        rated = graph.filter("seed = 0").join(instances, "instance").groupBy("pattern").agg(F.sum("belief").alias("gained"), F.sum("one").alias("found"))
        gained, found = (F.coalesce(c, F.lit(0.0)) for c in ("gained", "found"))
        patterns = patterns.join(rated, "pattern", "left").select(
            "pattern", ((F.col("seeds") + gained) / F.col("n")).alias("confidence"), "seeds", (F.col("seeds") + found).alias("support"), "n"
        )
    return patterns.select("pattern", _weight().alias("confidence"), "support")


def _weight() -> Column:
    """A pattern's confidence, shrunk where few seeds and accepted instances support it."""
    return F.least(F.col("confidence") * F.col("support") / (F.col("support") + 1), F.lit(0.999))


def _belief(weight: Column) -> Column:
    """The chance that not all patterns of a group err; rounded, as sums of doubles depend on their order."""
    return F.round(1 - F.exp(F.sum(F.log(1 - weight))), 9)


def _accepted(spans: DataFrame, patterns: DataFrame, accept: float, support: int) -> DataFrame:
    """row, kind, start, end, instance of the loose spans that trusted patterns accept; of those that overlap, the most certain, then the longest, goes first."""
    span = ("kind", "start", "end", "instance")
    loose = spans.filter(~F.col("seed")).select("row", *span, F.explode("patterns").alias("pattern"))
    trusted = patterns.filter(F.col("support") >= support).filter(F.col("confidence") >= RELIABLE)
    belief = loose.join(trusted, "pattern").groupBy("row", *span).agg(_belief(F.col("confidence")).alias("belief"))
    w = Window.partitionBy("row").orderBy("start", "end", "kind")
    good = belief.filter(F.col("belief") >= accept).withColumn("reach", F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    good = good.withColumn("cluster", F.count_if(F.col("start") >= F.coalesce("reach", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ranked = F.struct((-F.col("belief")).alias("doubt"), (F.col("start") - F.col("end")).alias("short"), "start", "end", "kind", "instance")
    clusters = good.groupBy("row", "cluster").agg(F.array_sort(F.collect_list(ranked)).alias("s"))

    def keep(kept: Column, m: Column) -> Column:
        one = F.array(F.struct(*[m[c].alias(c) for c in span]))
        return F.when(F.exists(kept, lambda k: (k["start"] < m["end"]) & (m["start"] < k["end"])), kept).otherwise(F.concat(kept, one))

    none = F.array().cast("array<struct<kind:int,start:int,end:int,instance:bigint>>")
    return clusters.select("row", F.explode(F.aggregate("s", none, keep)).alias("s")).select("row", "s.*")


def extended(spans: DataFrame, accept: float = ACCEPT, support: int = SUPPORT) -> DataFrame:
    """row, kind, start, end of the added spans."""
    return _accepted(spans, scored_patterns(spans, accept=accept, support=support), accept, support).select("row", "kind", "start", "end")


def _is(k: int):
    return lambda s: s["kind"] == k


def _text(spans: Column) -> Column:
    name = lambda s: F.element_at(F.array(*map(F.lit, (*KINDS, "secret"))), s["kind"] + 1)
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", name(s), s["start"], s["end"])), ",")


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, base counts, base_sha256, spans (base and added), n_added, n_secret, secret_spans and has_private of every row.

    The four kinds fill the counts and spans; secrets, found and added, have columns of their own.
    """
    rows = written(located(docs.select("doc_id", "text")))
    spans = written(spans_of(rows))
    found = spans.filter("seed").select("row", "kind", "start", "end", F.lit(True).alias("base")).unionByName(extended(spans).withColumn("base", F.lit(False)))
    by_row = found.groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end", "base")).alias("all"))
    none = F.array().cast("array<struct<kind:int,start:int,end:int,base:boolean>>")
    out = rows.select("row", "doc_id").join(by_row, "row", "left").withColumn("all", F.coalesce("all", none))
    out = out.withColumn("plain", F.filter("all", lambda s: s["base"] & (s["kind"] < SECRET))).withColumn("known", F.filter("all", lambda s: s["kind"] < SECRET)).withColumn("secrets", F.filter("all", _is(SECRET)))
    counts = [F.size(F.filter("plain", _is(k))).cast("bigint").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return out.select(
        "doc_id", *counts, F.sha2(_text(F.col("plain")), 256).alias("base_sha256"), _text(F.col("known")).alias("spans"),
        (F.size("known") - F.size("plain")).cast("bigint").alias("n_added"), F.size("secrets").cast("bigint").alias("n_secret"),
        _text(F.col("secrets")).alias("secret_spans"), (F.size("all") > 0).alias("has_private"),
    )
