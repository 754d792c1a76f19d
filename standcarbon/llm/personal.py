"""Personal data by fixed patterns and bootstrapped contextual extraction. DataFrame functions only.

The fixed patterns find base spans. Identifier-like strings (with three digits or an at sign) are
instances; the words beside an instance, with its coarse form, are lexical patterns. Instances that
are personal data by the fixed patterns are seeds. A pattern's confidence for a kind is the share
of its distinct instances known to be of that kind; instances under a pattern of high confidence
become known, which raises other patterns, until nothing changes. What stands under a
high-confidence pattern is then a span of that kind, whether or not a fixed pattern matches it.

Only numbers leave the texts: offsets, and hashes of instances and patterns. The graph is pruned
before it is scored to patterns that have seeds of one kind and something unknown to say.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from standcarbon.session import discard, staged

KINDS = ("email", "ip", "card", "phone")
# A pattern says nothing with fewer distinct seeds of a kind.
MIN_SEEDS = 5
CONFIDENCE = 0.8
ROUNDS = 10
# Words beside an instance are looked for in so many characters.
CONTEXT_CHARS = 80

# The base patterns. They are written so that each attempt is linear in the text:
# runs are entered at their start (or after the match before) and never given back, which changes
# no match, as what follows a run is not in its class.
_EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?:[ -]?[0-9]){13,}+"
_PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
_PATTERNS = (_EMAIL, _IP, _CARD, _PHONE)
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_ADDRESS = rf"^{_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}$"

# A token with an at sign or three digits, a short "+n " before it, and numbers that follow it.
_INSTANCE = (
    r"(?<!\S)(?:\+[0-9]{1,3} )?(?=[^\s@]*+@|(?:[^\s0-9]*+[0-9]){3})\S++(?: [0-9().\-]++(?!\S))*+"
)
_LEAD, _TAIL = r"^[^A-Za-z0-9+(]+", r"(?<![^A-Za-z0-9)])[^A-Za-z0-9)]++$"
_SCAN = 256


def _scan(values: Column) -> Column:
    """Exclusive running sums of a short array."""
    start = F.struct(F.lit(0).cast("long").alias("s"), F.array().cast("array<long>").alias("out"))
    return F.aggregate(
        values,
        start,
        lambda a, x: F.struct((a["s"] + x).alias("s"), F.concat(a["out"], F.array(a["s"])).alias("out")),
        lambda a: a["out"],
    )


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def _let(value: Column, body) -> Column:
    """`body` of a value that is computed once, however often `body` names it."""
    return F.transform(F.array(value), body)[0]


def running(values: Column) -> Column:
    """Exclusive running sums of an array<long> of any length, in runs of _SCAN."""

    def cut(v: Column) -> Column:
        last = F.floor((F.greatest(F.size(v), F.lit(1)) - 1) / _SCAN).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(v, i * _SCAN + 1, F.lit(_SCAN)))

    def shifted(runs: Column) -> Column:
        heads = _scan(F.transform(runs, _sum))
        return F.flatten(
            F.zip_with(runs, heads, lambda run, head: F.transform(_scan(run), lambda s: s + head))
        )

    return _let(_let(values, cut), shifted)


def _long(text: Column) -> Column:
    return F.length(text).cast("long")


def _luhn(digits: Column) -> Column:
    def value(i: Column) -> Column:
        digit = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        twice = F.when(digit > 4, digit * 2 - 9).otherwise(digit * 2)
        return F.when(i % 2 == 0, twice).otherwise(digit)

    places = F.sequence(F.lit(1), F.length(digits))
    return F.aggregate(places, F.lit(0), lambda a, i: a + value(i)) % 10 == 0


def _valid(kind: int, found: Column) -> Column:
    if kind == 1:
        return found.rlike(_ADDRESS)
    if kind == 2:
        digits = F.regexp_replace(found, "[ -]", "")
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)
    if kind == 3:
        return F.length(F.regexp_replace(found, "[^0-9]", "")).between(10, 15)
    return F.lit(True)


def _seed_kind(value: Column) -> Column:
    kind = F.lit(None).cast("int")
    for k in reversed(range(len(KINDS))):
        whole = value.rlike(f"^(?:{_PATTERNS[k]})$")
        kind = F.when(whole & _valid(k, value), F.lit(k)).otherwise(kind)
    return kind


def _located(df: DataFrame, name: str, text: Column, pattern: str, guard: Column | None = None) -> DataFrame:
    """`df` with `name`: array of (found, gap, start, before, after) of all matches, in order;
    before and after are the texts between matches."""
    nothing = F.array().cast("array<string>")
    found, pieces = F.regexp_extract_all(text, F.lit(pattern), 0), F.split(text, pattern, -1)
    if guard is not None:
        found = F.when(guard, found).otherwise(nothing)
    known = df.withColumn("_found", found)
    known = known.withColumn("_pieces", F.when(F.size("_found") > 0, pieces).otherwise(nothing))
    steps = F.zip_with("_found", "_pieces", lambda m, p: F.coalesce(_long(m), F.lit(0)) + _long(p))
    known = known.withColumn("_starts", F.when(F.size("_found") > 0, running(steps)).otherwise(F.array().cast("array<long>")))
    n = F.size("_found")
    # What a lambda names is computed for each element; these are its arguments instead.
    zipped = F.arrays_zip(
        F.col("_found").alias("found"), F.slice("_starts", F.lit(1), n).alias("start"),
        F.slice("_pieces", F.lit(1), n).alias("before"), F.slice("_pieces", F.lit(2), n).alias("after"),
    )
    made = F.transform(
        zipped,
        lambda m: F.struct(
            m["found"].alias("found"),
            (m["start"] + _long(m["before"])).alias("start"),
            F.substring(m["before"], -CONTEXT_CHARS, CONTEXT_CHARS).alias("before"),
            F.substring(m["after"], 1, CONTEXT_CHARS).alias("after"),
        ),
    )
    return known.withColumn(name, made).drop("_found", "_pieces", "_starts")


def _span(start: Column, kind: Column, end: Column) -> Column:
    return F.struct(start.cast("long").alias("start"), kind.cast("int").alias("kind"), end.cast("long").alias("end"))


def _base(found: Column, kind: int) -> Column:
    kept = F.filter(found, lambda m: _valid(kind, m["found"]))
    return F.transform(kept, lambda m: _span(m["start"], F.lit(kind), m["start"] + _long(m["found"])))


def _count(spans: str, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def _word(text: Column) -> Column:
    """Letters and digits of a word, in lower case; NULL if there are none."""
    plain = F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]+", ""))
    return F.when(plain != "", plain)


def _read(m: Column) -> Column:
    """The parts of a located instance that patterns are made of."""
    return F.struct(
        F.regexp_replace(F.regexp_replace(m["found"], _LEAD, ""), _TAIL, "").alias("value"),
        (m["start"] + _long(F.regexp_extract(m["found"], _LEAD, 0))).alias("start"),
        _word(F.regexp_extract(m["before"], r"(\S+)\s*$", 1)).alias("last"),
        _word(F.regexp_extract(m["before"], r"(\S+)\s+\S+\s*$", 1)).alias("second"),
        _word(F.regexp_extract(m["after"], r"^\s*(\S+)", 1)).alias("following"),
    )


def _occurrence(r: Column) -> Column:
    """(start, end, instance, kind, patterns) of an instance."""
    value = r["value"]
    form = F.when(F.contains(value, F.lit("@")), "@").when(value.rlike("[A-Za-z]"), "m").otherwise("d")

    def pattern(name: str, *words: str) -> Column:
        known = r[words[0]].isNotNull()
        for w in words[1:]:
            known = known & r[w].isNotNull()
        return F.when(known, F.xxhash64(F.lit(name), form, *[r[w] for w in words]))

    patterns = F.array(pattern("l", "last"), pattern("ll", "second", "last"), pattern("lr", "last", "following"))
    return F.struct(
        r["start"].alias("start"),
        (r["start"] + _long(value)).alias("end"),
        F.xxhash64(F.lower(value)).alias("instance"),
        _seed_kind(value).alias("kind"),
        F.array_compact(patterns).alias("patterns"),
    )


def measured(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """_row, _id, base (spans, sorted) and occurrences of every row of `docs`, staged; no texts."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("_id"), whole.alias("_whole"))
    t = F.col("_whole")
    guards = (F.contains(t, F.lit("@")), t.rlike(r"[0-9]\.[0-9]"), None, F.contains(t, F.lit("+")))
    for k, (pattern, guard) in enumerate(zip(_PATTERNS, guards, strict=True)):
        rows = _located(rows, f"_k{k}", t, pattern, guard)
    rows = _located(rows, "_seen", t, _INSTANCE)
    parts = [_base(F.col(f"_k{k}"), k) for k in range(len(KINDS))]
    made = rows.select(
        "_id",
        F.array_sort(F.concat(*parts)).alias("base"),
        F.transform(F.transform("_seen", _read), _occurrence).alias("occurrences"),
    )
    return staged(made.withColumn("_row", F.monotonically_increasing_id()))


def _occurrences(rows: DataFrame) -> DataFrame:
    return rows.select("_row", F.explode("occurrences").alias("o")).select("_row", "o.*")


def confident_patterns(
    rows: DataFrame, min_seeds: int = MIN_SEEDS, confidence: float = CONFIDENCE, rounds: int = ROUNDS
) -> DataFrame:
    """(pattern, kind, sure) of the patterns that reach `confidence`, by scoring rounds."""
    edges = _occurrences(rows).select("instance", "kind", F.explode("patterns").alias("pattern"))
    edges = staged(edges.groupBy("pattern", "instance").agg(F.min("kind").alias("kind")))
    seeds = [f"s{k}" for k in range(len(KINDS))]
    counted = edges.groupBy("pattern").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("kind").isNull()).alias("n_new"),
        *[F.count_if(F.col("kind") == k).alias(s) for k, s in enumerate(seeds)],
    )
    patterns = staged(counted.filter((F.col("n_new") > 0) & (F.greatest(*seeds) >= min_seeds)))
    unknown = staged(
        edges.filter("kind is null").join(patterns.select("pattern"), "pattern").select("pattern", "instance")
    )
    discard(edges)
    known, before = None, 0
    for _ in range(rounds):
        scored = patterns
        if known is not None:
            found = unknown.join(known, "instance").groupBy("pattern").agg(
                *[F.count_if(F.col("kind") == k).alias(f"more{k}") for k in range(len(KINDS))]
            )
            scored = patterns.join(found, "pattern", "left").select(
                "pattern", "n",
                *[(F.col(s) + F.coalesce(f"more{k}", F.lit(0))).alias(s) for k, s in enumerate(seeds)],
            )
        best = F.array_max(
            F.array(*[F.struct((F.col(s) / (F.col("n") + 1)).alias("sure"), F.lit(-k).alias("k")) for k, s in enumerate(seeds)])
        )
        good = scored.select("pattern", best.alias("b"))
        good = good.select("pattern", (-F.col("b.k")).alias("kind"), F.col("b.sure").alias("sure"))
        good = staged(good.filter(F.col("sure") >= confidence))
        top = F.max(F.struct("sure", (-F.col("kind")).alias("k")))
        known = unknown.join(good, "pattern").groupBy("instance").agg(top.alias("b"))
        known = staged(known.select("instance", (-F.col("b.k")).alias("kind")))
        now = known.count()
        if now == before:
            break
        before = now
    return good


def discovered(rows: DataFrame, patterns: DataFrame) -> DataFrame:
    """(_row, extra): spans under confident patterns that touch no base span."""
    new = _occurrences(rows).filter("kind is null").select("_row", "start", "end", F.explode("patterns").alias("pattern"))
    top = F.max(F.struct("sure", (-F.col("kind")).alias("k")))
    met = new.join(patterns, "pattern").groupBy("_row", "start", "end").agg(top.alias("b"))
    met = met.select("_row", "start", "end", (-F.col("b.k")).alias("kind"), F.lit(1).alias("new"))
    met = staged(met.filter(F.col("end") > F.col("start")))
    base = rows.join(met.select("_row").distinct(), "_row", "left_semi")
    base = base.select("_row", F.explode("base").alias("s"))
    base = base.select("_row", "s.start", "s.end", "s.kind", F.lit(0).alias("new"))
    order = Window.partitionBy("_row").orderBy("start", "new")
    ends = F.max(F.when(F.col("new") == 0, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.min(F.when(F.col("new") == 0, F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    both = base.unionByName(met).withColumns({"_ends": ends, "_starts": starts})
    free = (F.coalesce("_ends", F.lit(0)) <= F.col("start")) & (F.coalesce("_starts", F.col("end")) >= F.col("end"))
    kept = both.filter((F.col("new") == 1) & free)
    # The spans of one text.
    return kept.groupBy("_row").agg(
        F.collect_list(_span(F.col("start"), F.col("kind"), F.col("end"))).alias("extra")
    )


def shown(spans: Column) -> Column:
    """kind:start:end of sorted spans, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ","
    )


def find_personal_data(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    min_seeds: int = MIN_SEEDS,
    confidence: float = CONFIDENCE,
) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_extra for every row.

    Counts and digest are of the base spans; `spans` also has the discovered ones, whose number is
    n_extra. Null and empty texts have none; repeated rows stay, and count once as instances, as
    equal strings do; an empty table gives an empty result; other columns are not looked at.
    """
    rows = measured(docs, doc_id, text)
    extra = discovered(rows, confident_patterns(rows, min_seeds, confidence))
    joined = rows.drop("occurrences").join(extra, "_row", "left")
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    more = F.coalesce("extra", none)
    counts = [_count("base", k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return joined.select(
        F.col("_id").alias(doc_id), *counts,
        F.sha2(shown(F.col("base")), 256).alias("base_sha256"),
        shown(F.array_sort(F.concat("base", more))).alias("spans"),
        F.size(more).cast("long").alias("n_extra"),
    )
