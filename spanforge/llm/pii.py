"""Personal data by bootstrapped contextual extraction; DataFrame functions only.

Base spans of four kinds are found by their form. They seed the method: the words beside a seed induce lexical patterns
(kind, one or two words before or one after); candidates are identifier-like strings that no base span covers; patterns and instances form a
graph. Over some rounds a pattern's confidence is the share of its instances' weight that carries its kind, and a
candidate's belief in a kind is one minus the product of its patterns' doubts. Candidates of high belief are seeds of the
next round, in which they admit further patterns. Candidates that patterns of high confidence and enough distinct seeds
propose, and whose own belief is high, become spans of that kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, table, text_of

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
#: A pattern counts if it stands before so many distinct seeds, and so much of what it stands before is of its kind.
MIN_SEEDS, MIN_CONFIDENCE = 5, 0.8

# A match starts where the run of its first class starts, or where the match before ended: no other start can succeed, so
# each run is looked at once. Repeats are possessive where what follows can't give back: no deep recursion in long runs.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
_CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Candidates, none with a cap on its length. Groups of digits with a space or marks between; an address whose marks are in
# brackets or spelled out, with or without spaces; letters, digits and joining marks with a digit, an at sign or a bracketed
# mark inside, of six characters or more.
_DIGIT_GROUPS = r"(?<![A-Za-z0-9@._%+-])[+(]?[0-9]++(?:[\x20().-]{1,3}+[0-9]++)++(?![A-Za-z0-9@_%+-])"
_AT, _DOT = r"(?:\x20?[(\[{]\x20?at\x20?[)\]}]\x20?|\x20at\x20|\x20?@\x20?)", r"(?:\x20?[(\[{]\x20?dot\x20?[)\]}]\x20?|\x20dot\x20|\.)"
_SPELLED = rf"(?<![A-Za-z0-9@._%+-])[A-Za-z0-9_%+-]++(?:{_DOT}[A-Za-z0-9_%+-]++)*+{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)++(?![A-Za-z0-9@_%+-])"
_TOKEN = r"(?<![A-Za-z0-9@._%+-])(?=[A-Za-z._%+()-]*+[0-9@])[A-Za-z0-9+(][A-Za-z0-9@._%+()-]{4,}+(?<=[A-Za-z0-9.)%+_-])"
_CANDIDATE = rf"(?i:{_SPELLED})|{_DIGIT_GROUPS}|{_TOKEN}"
#: Marks that end a candidate are not part of it.
_TAIL = r"[^A-Za-z0-9]+\z"
_NEAR_CHARS = 48
#: Patterns of a mention: one and two words before, the word after, each with its side.
_SIDES = ("l1", "l2", "r1")


def _spans(text: Column, pattern: str, might: Column) -> Column:
    """array of (start, end, value) in code points, leftmost and non-overlapping; ``might`` is false where none can be."""
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    matches = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    between = F.split(text, pattern, -1)
    start = F.struct(F.lit(0).alias("at"), none.alias("found"))

    def step(acc: Column, pair: Column) -> Column:
        a = acc["at"] + F.char_length(pair["gap"])
        b = a + F.char_length(pair["value"])
        return F.struct(b.alias("at"), F.concat(acc["found"], F.array(F.struct(a.alias("start"), b.alias("end"), pair["value"].alias("value")))).alias("found"))

    pairs = F.zip_with(F.slice(between, 1, F.greatest(F.size(between) - 1, F.lit(0))), matches, lambda gap, value: F.struct(gap.alias("gap"), value.alias("value")))
    return F.when(might, F.aggregate(pairs, start, step)["found"]).otherwise(none)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def place(ch: Column, i: Column) -> Column:
        d = ch.cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return F.when((F.length(digits) - i) % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.transform(F.split(digits, "(?!^)(?=.)"), place), F.lit(0), lambda a, b: a + b) % 10 == 0


def base_spans(text: Column) -> Column:
    """array of (kind, start, end, value) of the base definitions, by kind, then start."""
    ok = {
        "email": lambda s: F.lit(True),
        "ip": lambda s: F.forall(F.split(s["value"], r"\."), lambda p: p.rlike(r"\A0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])\z")),
        "card": lambda s: _luhn(_digits(s["value"])),
        "phone": lambda s: F.length(_digits(s["value"])).between(8, 15),
    }
    found = {
        "email": _spans(text, _EMAIL, F.contains(text, F.lit("@"))),
        "ip": _spans(text, _IP, text.rlike(r"[0-9]\.[0-9]")),
        "card": _spans(text, _CARD, text.rlike("[0-9][0-9 -]{14}")),
        "phone": _spans(text, _PHONE, text.rlike(r"\+[0-9]")),
    }
    def named(kind: str) -> Column:
        return F.transform(F.filter(found[kind], ok[kind]), lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))

    return F.concat(*map(named, KINDS))


def _patterns(text: Column, start: Column, end: Column) -> Column:
    """The lexical patterns at a place: the last one and two words before, the first word after, lower case, marks kept,
    with the side in front; those that aren't there are left out. A word longer than the look is taken as what is seen of it."""
    before = F.lower(F.substring(text, F.greatest(start - _NEAR_CHARS + 1, F.lit(1)), F.least(start, F.lit(_NEAR_CHARS))))
    after = F.lower(F.substring(text, end + 1, F.lit(_NEAR_CHARS)))
    words = (
        F.regexp_extract(before, r"(\S+)\s*\z", 1),
        F.regexp_replace(F.regexp_extract(before, r"(\S+\s+\S+)\s*\z", 1), r"\s+", " "),
        F.regexp_extract(after, r"\A[^\w\s]*\s*(\S*\w)", 1),
    )
    return F.filter(F.array(*[F.when(w != "", F.concat(F.lit(f"{k} "), w)) for k, w in zip(_SIDES, words, strict=True)]), lambda p: p.isNotNull())


def _shape(value: Column) -> Column:
    """Runs of letters as a, of digits as 9."""
    return F.regexp_replace(F.regexp_replace(value, "[A-Za-z]+", "a"), "[0-9]+", "9")


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """One row per input row: ``id_col``, base and spans (arrays of kind, start, end; end exclusive, in code points, by kind, then start).

    A null text is empty. Added spans never touch base spans. Rows that repeat an id each get the spans of their own text.
    No rows give no rows. Other columns are ignored.
    """
    key = [F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("_id"), F.xxhash64(text_of(text_col)).alias("_hash")]
    texts = docs.select(*key, F.col(id_col).alias("_shown"), text_of(text_col).alias("_text"))
    based = texts.withColumn("_base", base_spans(F.col("_text")))
    might = F.col("_text").rlike(r"(?i)[0-9@]|[\x20(\[{]at[\x20)\]}]")
    apart = lambda c: ~F.exists("_base", lambda b: (b["start"] < c["end"]) & (b["end"] > c["start"]))
    def bare(c: Column) -> Column:
        value = F.regexp_replace(c["value"], _TAIL, "")
        return F.struct(c["start"].alias("start"), (c["start"] + F.char_length(value)).alias("end"), value.alias("value"))

    seen = lambda s, kind: F.struct(
        kind.cast("string").alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lower(s["value"]).alias("value"), _patterns(F.col("_text"), s["start"], s["end"]).alias("patterns")
    )
    looked = based.select(
        "_id",
        "_hash",
        "_shown",
        F.transform("_base", lambda s: seen(s, s["kind"])).alias("_base"),
        F.transform(F.filter(F.transform(_spans(F.col("_text"), _CANDIDATE, might), bare), lambda c: (F.char_length(c["value"]) >= 6) & apart(c)), lambda s: seen(s, F.lit(None))).alias("_open"),
    )
    looked = materialize(looked, "pii-spans")

    mentions = looked.select("_id", "_hash", F.explode(F.concat("_base", "_open")).alias("s")).select("_id", "_hash", "s.kind", "s.start", "s.end", "s.value", F.explode("s.patterns").alias("pattern"))
    # the graph: how often each instance stands after each pattern; an instance is a string and, if a seed, its kind
    edges = materialize(mentions.groupBy("pattern", "value", "kind").agg(F.count(F.lit(1)).alias("n")), "pii-edges")
    kinds = F.explode(F.array(*[F.lit(k) for k in KINDS])).alias("of")
    belief = None
    for _ in range(rounds):
        weighed = edges.select("pattern", "value", "kind", kinds)
        if belief is None:
            weighed = weighed.withColumn("b", F.when(F.col("kind") == F.col("of"), 1.0).otherwise(0.0))
        else:
            weighed = weighed.join(belief, ["value", "of"], "left").withColumn(
                "b", F.when(F.col("kind").isNotNull(), (F.col("kind") == F.col("of")).cast("double")).otherwise(F.coalesce("belief", F.lit(0.0)))
            )
        # distinct instances, not mentions: a passage copied often is one witness; what is believed is a seed of the next round
        n_seeds = F.count_distinct(F.when(F.col("b") >= min_confidence, F.col("value")))
        patterns = weighed.groupBy("pattern", "of").agg(F.avg("b").alias("confidence"), n_seeds.alias("n_seeds")).filter(F.col("n_seeds") >= min_seeds)
        patterns = materialize(patterns, "pii-patterns")
        doubts = edges.filter("kind is null").select("pattern", "value").join(patterns, "pattern")
        belief = doubts.groupBy("value", "of").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-6)))))).alias("belief"))
        belief = materialize(belief, "pii-belief")
    strong = edges.filter("kind is null").select("pattern", "value").join(patterns.filter(F.col("confidence") >= min_confidence), "pattern").join(
        belief.filter(F.col("belief") >= min_confidence), ["value", "of"]
    )
    best = strong.groupBy("pattern", "value").agg(F.max(F.struct("confidence", "of")).alias("found"))
    # one kind a span: that of the pattern of the highest confidence
    spans = mentions.filter("kind is null").join(best, ["pattern", "value"]).groupBy("_id", "_hash", "start", "end").agg(F.max("found").alias("found"))
    added = spans.groupBy("_id", "_hash").agg(F.collect_set(F.struct(F.col("found.of").alias("kind"), "start", "end")).alias("_added"))
    plain = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    rank = lambda s: F.array_position(F.array(*[F.lit(k) for k in KINDS]), s["kind"])
    ordered = lambda spans: F.transform(
        F.array_sort(F.transform(spans, lambda s: F.struct(rank(s).alias("r"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))), plain
    )
    out = looked.select("_id", "_hash", "_shown", F.transform("_base", plain).alias("base")).join(added, ["_id", "_hash"], "left")
    return out.select(F.col("_shown").alias(id_col), "base", ordered(F.concat("base", F.coalesce("_added", F.array().cast("array<struct<kind:string,start:int,end:int>>")))).alias("spans"))


def op1_pii(spark, sf_dir: str) -> DataFrame:
    out = pii_spans(table(spark, sf_dir, "documents"))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    n = [F.size(F.filter("spans", lambda s: s["kind"] == F.lit(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", *n, F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))
