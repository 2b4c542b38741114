"""Secret scan: fixed patterns, and character Markov models that tell random strings from ordinary identifiers.

All of it is DataFrame functions. Offsets are code points, the end is exclusive. The models hold
log2 P(next character | character); a token's score is the sum of the log-likelihood ratios of its
transitions under the model of random strings and the model of ordinary identifiers.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyrack.llm.common import share, text_of

#: Patterns: fixed values. Failing matches (too short) are dropped after matching.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "random")
LEAST = {"assign": 6, "access": 20, "hex": 24}
#: Runs of this many characters that the models judge.
TOKEN = r"[A-Za-z0-9+/_=-]{16,}"
#: Bits by which a token must be likelier as a random string: in all, and a transition on average.
BITS = 18.0
BITS_EACH = 0.9
#: Documents whose tokens train the models, at most (about: taken by hash of the id).
TRAIN_DOCS = 20_000
#: Pseudo-count a character's row of transitions starts with, spread evenly.
PRIOR = 8.0
#: Characters that join words to an identifier.
JOINERS = "_-/=+"
#: Ordinary identifiers beyond the words of the texts. Where a digit leads on to: digits, joiners, letters.
AFTER_DIGIT = (0.75, 0.15, 0.10)
#: How often letters and joiners lead on to a digit, to themselves, and to any letter of the same and of the other case.
TO_DIGIT = 0.04
TO_ITSELF = 0.05
TO_LETTER = 0.08
TO_OTHER_CASE = 0.02
_CODES = 128
_SPAN = "array<struct<start:int,rank:int,end:int,value:string,byte:int,byte_end:int>>"


def _found(text: Column, pattern: str, rank: int, keep, value_group: int = 0) -> Column:
    """Spans of the matches that ``keep(value)`` accepts, in order.

    Splitting gives the text between the matches; a running position over both gives the offsets.
    Only kept spans are appended.
    """
    parts = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)).alias("value"),
    )
    none = F.expr(f"cast(array() as {_SPAN})")

    def step(acc: Column, part: Column) -> Column:
        start = acc["at"] + F.length(part["gap"])
        end = start + F.coalesce(F.length(part["hit"]), F.lit(0))
        byte = acc["byte"] + F.octet_length(part["gap"])
        byte_end = byte + F.coalesce(F.octet_length(part["hit"]), F.lit(0))
        span = F.struct(
            start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), part["value"].alias("value"), byte.alias("byte"), byte_end.alias("byte_end")
        )
        out = F.when(part["hit"].isNotNull() & keep(part["value"]), F.concat(acc["out"], F.array(span))).otherwise(acc["out"])
        return F.struct(end.alias("at"), byte_end.alias("byte"), out.alias("out"))

    first = F.struct(F.lit(0).alias("at"), F.lit(0).alias("byte"), none.alias("out"))
    return F.when(text.rlike(pattern), F.aggregate(parts, first, step, lambda acc: acc["out"])).otherwise(none)


def base_spans(text: Column) -> Column:
    """Array of (start, rank, end, value, byte, byte_end) of the three fixed kinds, unsorted.

    A hex or access match is a whole run, so asking for the run's least length in the pattern
    leaves out the same matches as dropping them afterwards.
    """
    assign = _found(text, ASSIGN, 0, lambda v: F.length(v) >= LEAST["assign"], 2)
    access = _found(text, f"AKIA[A-Z0-9]{{{LEAST['access'] - 4},}}", 1, lambda v: F.lit(True))
    hexes = _found(text, f"[0-9a-f]{{{LEAST['hex']},}}", 2, lambda v: F.lit(True))
    return F.concat(assign, access, hexes)


def _grid(docs: DataFrame) -> DataFrame:
    """Every transition there can be, ``(at, x, y)``, so that unseen ones get their prior."""
    code = F.array(*[F.lit(ord(c)) for c in "+-./=_"]), F.sequence(F.lit(48), F.lit(57)), F.sequence(F.lit(65), F.lit(90)), F.sequence(F.lit(97), F.lit(122))
    letters = docs.sparkSession.range(1).select(F.explode(F.concat(*code)).alias("a"))
    both = letters.select("a", F.explode(F.concat(*code)).alias("b"))
    return both.select((F.col("a") * _CODES + F.col("b")).alias("at"), F.char("a").alias("x"), F.char("b").alias("y"))


def _ordinary(counts: DataFrame, joins: DataFrame) -> DataFrame:
    """``(at, o)``: transitions of ordinary identifiers, from the words of the texts and their neighbours.

    A word counts as it is, capitalised and in capitals; two neighbours count joined in camel case
    and by each of ``JOINERS``. Weights are whole numbers, so that sums don't depend on their order.
    """
    x, y, n = F.substring("pair", 1, 1), F.substring("pair", 2, 1), F.col("n")

    def seen(a: Column, b: Column, weight: Column) -> Column:
        return F.struct((F.ascii(a) * _CODES + F.ascii(b)).alias("at"), weight.cast("bigint").alias("w"))

    whole = n * len(JOINERS)
    words = [seen(x, y, whole), seen(F.upper(x), F.upper(y), whole), seen(F.upper(x), y, F.when(F.col("first"), whole).otherwise(0))]
    glued = [seen(x, F.upper(y), whole)]
    for mark in map(F.lit, JOINERS):
        glued += [seen(x, mark, n), seen(F.upper(x), mark, n), seen(mark, y, n), seen(mark, F.upper(y), n)]
    rows = counts.filter("label = 0").select(F.inline(F.array(*words))).unionByName(joins.select(F.inline(F.array(*glued))))
    return rows.groupBy("at").agg(F.sum("w").alias("o"))


def _with_others() -> Column:
    """The ordinary count of a transition, with those of numerals, dates, rules and words that the texts lack.

    A letter or joiner goes on to digits, itself and letters in fixed shares of its row; a digit in the shares of
    ``AFTER_DIGIT``, with the weight of an average row. So no transition is near impossible for want of samples.
    """
    x, y, row = F.col("x"), F.col("y"), F.col("os")
    digit, joiner, lower, upper = "[0-9]", "[" + re.escape(JOINERS) + "]", "[a-z]", "[A-Z]"
    to_digits, to_joiners, to_letters = AFTER_DIGIT
    after = F.when(y.rlike(digit), to_digits / 10).when(y.rlike(joiner), to_joiners / len(JOINERS)).when(y == ".", 0.0).otherwise(to_letters / 52)
    same = (x.rlike(lower) & y.rlike(lower)) | (x.rlike(upper) & y.rlike(upper))
    letters = F.when(same, TO_LETTER / 26).when(y.rlike("[A-Za-z]"), TO_OTHER_CASE / 26).otherwise(0.0)
    itself = F.when(x == y, TO_ITSELF).otherwise(0.0)
    share_of_row = F.when(y.rlike(digit), TO_DIGIT / 10).otherwise(letters + itself)
    return F.col("o") + F.when(x.rlike(digit), after * F.col("mean")).otherwise(row * share_of_row)


def train(docs: DataFrame, rows: int = TRAIN_DOCS) -> list[float]:
    """Log2 likelihood ratio random / ordinary of each transition, at 128 * code + next code.

    The labelled samples come from up to about ``rows`` documents: what the fixed patterns catch
    is random; every other run of token characters is ordinary, and so are the identifiers made of
    such runs, numerals, dates and rules. At most 16,384 rows go to the driver. With no samples all
    ratios are 0.
    """
    total = docs.count()
    rows_of = docs.filter(F.col("doc_id").isNotNull() & (share("doc_id") < F.lit(min(1.0, rows / max(total, 1))))).select(text_of().alias("text"))
    random = rows_of.select(F.explode(base_spans(F.col("text"))).alias("span")).select(F.col("span.value").alias("word"), F.lit(1).alias("label"))
    rest = F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), r"AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}", " ")
    runs = rows_of.select(F.regexp_extract_all(rest, F.lit(r"[A-Za-z0-9+/_=-]{2,}"), F.lit(0)).alias("runs"))
    plain = runs.select(F.explode("runs").alias("word"), F.lit(0).alias("label"))
    words = random.unionByName(plain).groupBy("word", "label").agg(F.count("*").alias("n"))
    chars = words.select("label", "n", F.split("word", "").alias("chars"))
    two = F.zip_with("chars", F.slice("chars", F.lit(2), F.size("chars")), lambda a, b: F.concat(a, b))
    pairs = chars.select("label", "n", F.posexplode(two).alias("place", "pair")).filter("pair rlike '^[A-Za-z0-9+/_=.-]{2}$'")
    counts = pairs.groupBy("pair", (F.col("place") == 0).alias("first"), "label").agg(F.sum("n").alias("n"))
    ends = F.zip_with("runs", F.slice("runs", F.lit(2), F.size("runs")), lambda a, b: F.concat(F.right(a, F.lit(1)), F.left(b, F.lit(1))))
    joins = runs.select(F.explode(ends).alias("pair")).filter("pair is not null").groupBy("pair").agg(F.count("*").alias("n"))
    at = F.ascii(F.substring("pair", 1, 1)) * _CODES + F.ascii(F.substring("pair", 2, 1))
    caught = counts.filter("label = 1").groupBy(at.alias("at")).agg(F.sum("n").alias("r"))
    full = _grid(docs).join(caught, "at", "left").join(_ordinary(counts, joins), "at", "left").na.fill(0, ["r", "o"])
    of_row = full.groupBy("x").agg(F.sum("r").alias("rs"), F.sum("o").alias("os"))
    mean = full.agg((F.sum("o") / 68).alias("mean"))  # a single row
    known = full.join(of_row, "x").join(F.broadcast(mean)).withColumn("o", _with_others())
    known = known.withColumn("os", F.sum("o").over(Window.partitionBy("x").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    each = F.lit(PRIOR / 68)
    # secrets come from alphabets that the samples may lack: half of the random model is even over all characters
    random_p = ((F.col("r") + each) / (F.col("rs") + PRIOR) + F.lit(1 / 68)) / 2
    ratio = F.log2(random_p) - F.log2((F.col("o") + each) / (F.col("os") + PRIOR))
    out = [0.0] * (_CODES * _CODES)
    for row in known.select("at", ratio.alias("ratio")).collect():
        out[row["at"]] = round(row["ratio"], 6)
    return out


def _blanked(text: Column, spans: Column) -> Column:
    """The text with a space for every character of the spans; these are ASCII, so that all offsets stay."""
    data = text.cast("binary")

    def step(acc: Column, s: Column) -> Column:
        piece = F.substring(data, acc["at"] + 1, s["byte"] - acc["at"]).cast("string")
        blank = F.repeat(F.lit(" "), s["byte_end"] - F.greatest(acc["at"], s["byte"]))
        return F.struct(F.greatest(acc["at"], s["byte_end"]).alias("at"), F.concat(acc["out"], F.array(piece, blank)).alias("out"))

    first = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out"))
    rest = lambda acc: F.substring(data, acc["at"] + 1, F.octet_length(text)).cast("string")
    return F.when(F.size(spans) > 0, F.aggregate(spans, first, step, lambda acc: F.array_join(F.concat(acc["out"], F.array(rest(acc))), ""))).otherwise(text)


def scan(docs: DataFrame, ratios: list[float]) -> DataFrame:
    """Every row with ``spans``: array of (start, rank, end, value, byte, byte_end), by start, then kind.

    Kinds are ``KINDS[rank]``. A random span is a run of 16 or more token characters whose score
    passes both thresholds; spans of a fixed kind are no part of a run, what stands before and after
    them is judged on its own. A null text counts as empty and has no spans. A column named ``spans`` is replaced.
    """
    # one literal, folded once; a lookup is an array access
    model = F.from_json(F.lit("[" + ",".join(map(repr, ratios)) + "]"), "array<double>")

    def bits(word: Column) -> Column:
        # a running (code, sum) over the characters: a look-up by place would read the word from its start
        def step(acc: Column, char: Column) -> Column:
            code = F.ascii(char)
            gain = F.coalesce(F.get(model, acc["code"] * _CODES + code), F.lit(0.0))
            return F.struct(code.alias("code"), (acc["sum"] + gain).alias("sum"))

        return F.aggregate(F.split(word, ""), F.struct(F.lit(0).alias("code"), F.lit(0.0).alias("sum")), step, lambda acc: acc["sum"])

    def random(word: Column) -> Column:
        return bits(word) >= F.greatest(F.lit(BITS), F.lit(BITS_EACH) * (F.length(word) - 1))

    text = text_of()
    base = docs.drop("spans").withColumn("_base", F.array_sort(base_spans(text))).withColumn("_random", _blanked(text, F.col("_base")))
    found = base.withColumn("_random", _found(F.col("_random"), TOKEN, 3, random))
    return found.withColumn("spans", F.array_sort(F.concat("_base", "_random"))).drop("_base", "_random")


def listed(spans: Column) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"], s["end"])), ",")


def redact(text: Column, spans: Column, mark: str = "<secret>") -> Column:
    """The text with every span, or stretch of spans that overlap, replaced by ``mark``."""
    # byte offsets: a piece of the bytes is cut out without counting characters from the start
    data = text.cast("binary")

    def step(acc: Column, s: Column) -> Column:
        fresh = s["byte"] >= acc["at"]
        piece = F.array(F.substring(data, acc["at"] + 1, s["byte"] - acc["at"]).cast("string"), F.lit(mark))
        return F.struct(F.greatest(acc["at"], s["byte_end"]).alias("at"), F.when(fresh, F.concat(acc["out"], piece)).otherwise(acc["out"]).alias("out"))

    first = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out"))
    rest = lambda acc: F.substring(data, acc["at"] + 1, F.octet_length(text)).cast("string")
    end = F.aggregate(spans, first, step, lambda acc: F.array_join(F.concat(acc["out"], F.array(rest(acc))), ""))
    return F.when(F.size(spans) > 0, end).otherwise(text)
