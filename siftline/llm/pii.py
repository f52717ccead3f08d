"""Personal data by base patterns and bootstrapped contextual extraction, in DataFrame expressions only.

Base patterns give seed entities. Those, and every identifier-like token or
grouped number of the corpus beside them, are instances; the two words before
the whole instance are its lexical pattern, where identifiers and numbers are
all the same word. Seeds score
patterns (the mean score of a pattern's distinct instances, for one kind),
patterns score instances that are no seeds (the best of the patterns they occur
in), and the two repeat. A pattern with enough distinct seeds and a high score
is trusted, and instances of the kind's shape in its places become spans.

Java's ``\\G`` and a look-behind let a match begin only where a run begins or
the last match ended. That gives the leftmost non-overlapping matches and keeps
long runs linear; possessive groups keep them off the stack.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import cut, let, located, pages, running
from .common import flagged, materialize, read_table, whole_row

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without a match of these has no match that stands: cheap to search for.
HINTS = {
    "email": r"@[A-Za-z0-9-]++\.[A-Za-z0-9-]",
    "ip": r"[0-9]\.[0-9]++\.[0-9]",
    "card": r"[0-9](?:[\x20-]?[0-9]){12}",
    "phone": r"\+[0-9][\x20().0-9-]",
}
TOKEN = r"(?<![A-Za-z0-9@._+-])(?=[A-Za-z._+-]*+[0-9@])[A-Za-z0-9+][A-Za-z0-9@._+-]{4,}+"
#: What may stand between two digits of a grouped number.
GAP = r"(?:\x20?\(|\)[\x20-]?|[\x20.-])?"
GROUPED = rf"(?<![A-Za-z0-9@._+(-])\+?\(?[0-9](?:{GAP}[0-9]){{8,18}}+(?!{GAP}[0-9]|[A-Za-z0-9@_]|[@._+-]+[A-Za-z])"
INSTANCE = f"{GROUPED}|{TOKEN}"
#: A text read backwards: white space, a word, white space, a word.
BACK = r"^([\x20\x09-\x0D]*+)([^\x20\x09-\x0D]*+)([\x20\x09-\x0D]*+)([^\x20\x09-\x0D]*+)"
#: Characters before a place that are looked at for its two words; the next number where they are not whole in the one before.
REACHES = (128, 8192)
#: A word with this is an identifier or number among the words before a place.
IDENTIFIER = r"@|[0-9][.()-]{0,2}[0-9][.()-]{0,2}[0-9]"
SHAPES = {
    "email": r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*$",
    "ip": r"^[0-9]{1,3}(?:\.[0-9]{1,3}){2,3}\.?$",
    "card": r"^[0-9](?:[\x20-]?[0-9]){11,18}\.?$",
    "phone": rf"^\+?[0-9][0-9.-]{{7,14}}$|^\+?\(?[0-9](?:{GAP}[0-9]){{8,14}}$",
}
MARKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}
SPAN = "array<struct<kind:string,start:long,stop:long>>"
TOKENS = "array<struct<value:string,pattern:string,start:long,stop:long>>"
SEEDS = "array<struct<kind:string,start:long,stop:long,value:string,pattern:string>>"


@dataclass(frozen=True)
class Bootstrap:
    """A trusted pattern has so many distinct seeds and such a score; scores are found in so many rounds."""

    seeds: int = 5
    score: float = 0.9
    rounds: int = 3


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    from_right = F.split(F.reverse(digits), "")
    value = F.transform(from_right, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((2 * d.cast("int")) % 10 + F.floor(d.cast("int") / 5).cast("int")))
    return F.aggregate(value, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _stands(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return ~F.exists(F.split(value, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")) > 3) & ~F.exists(F.split(value, r"\."), lambda p: F.coalesce(p.try_cast("int") > 255, F.lit(True)) & (F.length(F.regexp_replace(p, "^0+", "")) == 3))
    if kind == "card":
        return F.length(digits).between(13, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _plain(word: Column) -> Column:
    """A word of a pattern: lower case, without marks at its ends; ``#`` for an identifier or number. Over 64 characters its digest stands for it."""
    bare = F.regexp_replace(F.lower(word), r"^[^\p{L}\p{N}]++|(?<![^\p{L}\p{N}])[^\p{L}\p{N}]++$", "")
    return F.when(word.rlike(IDENTIFIER), F.lit("#")).when(F.length(bare) > 64, F.md5(bare)).otherwise(bare)


def _pattern(paged: Column, start: Column, reaches: tuple[int, ...] = REACHES) -> Column:
    """The two words before a place. Empty where they and the white space about them take the last reach or more."""
    first = F.greatest(start - reaches[0], F.lit(0))
    word = lambda back, g: _plain(F.reverse(F.regexp_extract(back, BACK, g)))
    held = lambda back: (first == 0) | (F.length(F.regexp_extract(back, BACK, 0)) < reaches[0])
    further = _pattern(paged, start, reaches[1:]) if reaches[1:] else F.lit("")
    return let(F.reverse(cut(paged, first, start)), lambda b: F.when(held(b), F.concat_ws(" ", word(b, 4), word(b, 2))).otherwise(further))


def _standing(text: Column, kind: str, paged: Column | None = None) -> Column:
    """Base spans of a kind; with pages of the text also their values and patterns."""
    found = F.filter(located(text, PATTERNS[kind]), lambda m: _stands(kind, m["value"]))
    fields = lambda m: [F.lit(kind).alias("kind"), m["start"].cast("long").alias("start"), (m["start"] + F.length(m["value"])).cast("long").alias("stop")]
    more = lambda m: [m["value"].alias("value"), _pattern(paged, m["start"]).alias("pattern")] if paged is not None else []
    return F.when(text.rlike(HINTS[kind]), F.transform(found, lambda m: F.struct(*fields(m), *more(m)))).otherwise(F.array().cast(SPAN if paged is None else SEEDS))


def _seeds(text: Column) -> Column:
    """``SEEDS`` of the base patterns, by kind as listed, then start."""
    return let(pages(text), lambda p: F.concat(*[_standing(text, kind, p) for kind in KINDS]))


def _spans(seeds: Column) -> Column:
    return F.transform(seeds, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop")))


def base_spans(text: Column) -> Column:
    """``array<struct<kind, start, stop>>`` of the base patterns, by kind as listed, then start."""
    return F.concat(*[_standing(text, kind) for kind in KINDS])


def _of_kind(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def tokens(text: Column) -> Column:
    """Identifier-like tokens and grouped numbers with the two words before them."""

    def one(p, m):
        value = F.regexp_replace(m["value"], r"[._+-]+$", "")
        return F.struct(value.alias("value"), _pattern(p, m["start"]).alias("pattern"), m["start"].cast("long").alias("start"), (m["start"] + F.length(value)).cast("long").alias("stop"))

    found = let(pages(text), lambda p: F.transform(located(text, INSTANCE), lambda m: one(p, m)))
    return F.when(text.rlike("[0-9@]"), found).otherwise(F.array().cast(TOKENS))


def _apart(tokens: Column, seeds: Column) -> Column:
    """The tokens that meet none of the seeds: of those in order of place none before reaches it, none after starts in it."""
    fields = ("start", "own", "stop", "value", "pattern")
    as_rows = lambda xs, own: F.transform(xs, lambda x: F.struct(*[(F.lit(own) if f == "own" else x[f]).alias(f) for f in fields]))
    none, far = F.lit(0).cast("long"), F.lit(1 << 62).cast("long")

    def sweep(rows):
        till = running(F.transform(rows, lambda x: F.when(x["own"] == 0, x["stop"]).otherwise(none)), none, F.greatest)
        back = F.reverse(running(F.transform(F.reverse(rows), lambda x: F.when(x["own"] == 0, x["start"]).otherwise(far)), far, F.least))
        return let(till, lambda ts: let(back, lambda bs: F.filter(rows, lambda x, i: (x["own"] == 1) & (F.get(ts, i) <= x["start"]) & (F.get(bs, i) >= x["stop"]))))

    both = F.array_sort(F.concat(as_rows(seeds, 0), as_rows(tokens, 1)))
    return F.when((F.size(seeds) == 0) | (F.size(tokens) == 0), as_rows(tokens, 1)).otherwise(let(both, sweep))


def _keys(docs: DataFrame) -> list[Column]:
    """Two hashes that name a row by its id and text; equal rows have equal spans."""
    doc_id, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit(""))
    return [F.xxhash64(doc_id, text).alias("k1"), F.xxhash64(text, F.lit(1), doc_id).alias("k2")]


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, k1, k2, base, seeds, tokens`` of every row, written out; whole texts are read once."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = materialize(docs.select(F.col("doc_id").cast("long"), *_keys(docs), _seeds(text).alias("seeds"), tokens(text).alias("tokens")), "scan")
    return found.withColumn("base", _spans(F.col("seeds")))


def discover(found: DataFrame, options: Bootstrap = Bootstrap()) -> DataFrame:
    """``k1, k2, new``: spans that trusted patterns add to rows of ``scan``."""
    others = F.transform(_apart(F.col("tokens"), F.col("seeds")), lambda t: F.struct(t["value"].alias("value"), t["pattern"].alias("pattern"), t["start"].alias("start"), t["stop"].alias("stop"), F.lit(None).cast("string").alias("seed")))
    seeds = F.transform("seeds", lambda s: F.struct(s["value"].alias("value"), s["pattern"].alias("pattern"), s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("seed")))
    each = found.where("size(tokens) > 0 or size(seeds) > 0").select("k1", "k2", F.explode(F.concat(seeds, others)).alias("t"))
    places = each.select("k1", "k2", "t.*").where("length(pattern) > 1")
    places = materialize(places, "places")
    graph = places.groupBy("pattern", "value").agg(F.max("seed").alias("seed"))
    sums = graph.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("seed") == k).alias(k) for k in KINDS])
    # Only patterns with enough seeds of a kind can ever be trusted; the others' edges play no part.
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("seeds")) for k in KINDS]))
    patterns = materialize(sums.select(F.col("pattern").alias("p"), "n", kinds.alias("k")).select("p", "n", "k.*").where(F.col("seeds") >= options.seeds), "patterns")
    edges = materialize(graph.where("seed is null").join(patterns, F.col("pattern") == F.col("p")).select("p", "kind", "value", "n", "seeds"), "edges")
    scores = patterns.select("p", "kind", (F.col("seeds") / F.col("n")).alias("score"))
    for _ in range(options.rounds):
        held = materialize(scores, "scores").select(F.col("p").alias("p2"), F.col("kind").alias("k2"), "score")
        scored = edges.join(held, (F.col("p") == F.col("p2")) & (F.col("kind") == F.col("k2")))
        instances = materialize(scored.groupBy(F.col("value").alias("v"), F.col("kind").alias("k")).agg(F.max("score").alias("best")), "instances")
        unseen = edges.join(instances, (F.col("value") == F.col("v")) & (F.col("kind") == F.col("k"))).groupBy(F.col("p").alias("p2"), F.col("kind").alias("k2")).agg(F.sum(F.when(_shaped(), F.col("best")).otherwise(0.0)).alias("more"))
        scores = patterns.join(unseen, (F.col("p") == F.col("p2")) & (F.col("kind") == F.col("k2")), "left").select("p", "kind", ((F.col("seeds") + F.coalesce("more", F.lit(0.0))) / F.col("n")).alias("score"))
    trusted = materialize(scores.where(F.col("score") >= options.score), "trusted").select(F.col("p").alias("p2"), "kind")
    new = places.where("seed is null").join(trusted, F.col("pattern") == F.col("p2")).where(_shaped())
    return materialize(new.groupBy("k1", "k2").agg(F.array_sort(F.collect_set(F.struct("kind", "start", "stop"))).alias("new")), "new")


def _shaped() -> Column:
    out = F.lit(False)
    for k, pattern in SHAPES.items():
        out = out | ((F.col("kind") == k) & F.col("value").rlike(pattern))
    return out


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def find_pii(docs: DataFrame, options: Bootstrap = Bootstrap()) -> DataFrame:
    """``doc_id``, counts by kind, ``base_sha256`` and ``spans`` for every row of ``docs``.

    A null or empty text has no spans. Rows with null or repeated ids are kept,
    rows equal in id and text have equal spans. No rows give no rows. Columns
    other than doc_id and text are ignored. Texts of any length are searched
    whole, in time in proportion to length and matches. Of patterns with equal
    scores all that reach the threshold are trusted, so ties need no order.
    """
    found = scan(docs)
    new = discover(found, options).select(F.col("k1").alias("a"), F.col("k2").alias("b"), "new")
    found = found.join(new, (F.col("k1") == F.col("a")) & (F.col("k2") == F.col("b")), "left")
    every = F.concat("base", F.coalesce("new", F.array().cast(SPAN)))
    ordered = F.flatten(F.array(*[F.array_sort(_of_kind(every, k)) for k in KINDS]))
    counts = [F.size(_of_kind(F.col("base"), k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(ordered).alias("spans"))


def mask(docs: DataFrame, options: Bootstrap = Bootstrap()) -> DataFrame:
    """The rows of ``docs`` with all spans replaced by the mark of their kind; ``n_chars`` follows the text.

    Of overlapping spans the first's mark stands for both; of those that start
    together the shorter, then the kind first by name. Null texts stay null, empty
    ones empty; repeated rows are masked alike, texts of any length whole, and no
    rows give no rows.
    Texts are joined with found spans only where a bitmap of fixed size says that
    their row may have some.
    """
    new = discover(scan(docs), options).select(F.col("k1").alias("a"), F.col("k2").alias("b"), "new")
    keyed = flagged(docs.select(*_keys(docs), whole_row(docs)), F.col("k1"), new, "a")
    asked = keyed.where("_flag").join(new, (F.col("k1") == F.col("a")) & (F.col("k2") == F.col("b")), "left").select("row", "new")
    joined = asked.union(keyed.where("not _flag").select("row", F.lit(None).cast(SPAN)))
    text = F.col("row.text")
    marks = F.create_map(*[F.lit(x) for pair in MARKS.items() for x in pair])
    spans = F.array_sort(F.transform(F.concat(base_spans(text), F.coalesce("new", F.array().cast(SPAN))), lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
    none = F.lit(0).cast("long")
    till = lambda ss: running(F.transform(ss, lambda s: s["stop"]), none, F.greatest)

    def replaced(p, ss, ts):
        fresh = F.filter(F.transform(ss, lambda s, i: F.struct(F.get(ts, i).alias("from"), s["start"].alias("to"), marks[s["kind"]].alias("mark"))), lambda x: x["to"] >= x["from"])
        end = F.coalesce(F.array_max(F.transform(ss, lambda s: s["stop"])), none)
        return F.concat(F.array_join(F.transform(fresh, lambda x: F.concat(cut(p, x["from"], x["to"]), x["mark"])), ""), cut(p, end, F.length(text)))

    masked = let(pages(text), lambda p: let(spans, lambda ss: let(till(ss), lambda ts: replaced(p, ss, ts))))
    touched = F.col("new").isNotNull()
    for hint in HINTS.values():
        touched = touched | text.rlike(hint)
    held = joined.select("row", F.when(touched, masked).otherwise(text).alias("text"))
    out = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(text.isNull(), F.col("row.n_chars")).otherwise(F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return held.select(*[out.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(read_table(spark, sf_dir, "documents"))
