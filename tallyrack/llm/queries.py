"""The registered queries: each operator over its whole table, with the columns its contract names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrack.llm import chat, decontaminate, language, mixing, nearest, ngram_join, pages, pieces, quality, repair, resample, secret_scan, tokens
from tallyrack.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn: Callable) -> Callable:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return register


def fold(n: int):
    """Remainder of crc32 of the id as text; a null id falls into none."""
    return F.crc32(F.col("doc_id").cast("string")) % n


@query()
def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; trained on labelled rows outside the fold."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(fold(4) == 2, F.lit(False)))
    model = language.train(docs.filter(~F.col("held_out") & F.col("doc_id").isNotNull()))
    return language.identify(docs, model, ["doc_id", "held_out"])


#: Classes, links of similarity 0.8 or more and their components over documents table ``@``, by comparing all pairs.
NEAR_SQL = """
  words AS (
    SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM @),
  starts AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM words WHERE len(ws) > 0),
  grams AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') || CASE WHEN len(ws) < 5 THEN ' short' ELSE '' END AS g FROM starts),
  digests AS (SELECT doc_id, md5(string_agg(g, chr(10) ORDER BY g)) AS digest, count(*) AS n FROM grams GROUP BY 1),
  classes AS (SELECT digest, min(doc_id) AS class_id, count(*) AS class_size, min(n) AS n FROM digests GROUP BY 1),
  heads AS (SELECT class_id, class_size, n, g FROM classes JOIN grams ON doc_id = class_id),
  links AS (
    SELECT a.class_id AS a, b.class_id AS b, any_value(b.class_size) AS size
    FROM heads a JOIN heads b ON a.g = b.g AND a.class_id <> b.class_id
    GROUP BY 1, 2 HAVING 9 * count(*) >= 4 * (any_value(a.n) + any_value(b.n))),
  reach AS (SELECT class_id AS a, class_id AS b FROM classes UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
  sums AS (SELECT a, sum(size) AS n FROM links GROUP BY 1),
  low AS (SELECT a, min(b) AS group_id FROM reach GROUP BY 1),
  near AS (
    SELECT doc_id, coalesce(class_id, doc_id) AS class_id, coalesce(class_size, 1)::BIGINT AS class_size,
           coalesce(sums.n + class_size - 1, class_size - 1, 0)::BIGINT AS n_links, coalesce(group_id, doc_id) AS group_id
    FROM words LEFT JOIN digests USING (doc_id) LEFT JOIN classes USING (digest)
    LEFT JOIN sums ON sums.a = class_id LEFT JOIN low ON low.a = class_id)"""


@query(f"WITH RECURSIVE {NEAR_SQL.replace('@', 'documents')} SELECT * FROM near")
def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class, links and group of every document at similarity 0.8 over five-word shingles."""
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"))


#: Conversation -7 of the contract.
PROBE = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
_ESCAPED = "replace(@, chr(92), chr(92) || chr(92))"
for _word in chat.CONTROL:
    _ESCAPED = f"replace({_ESCAPED}, '{_word}', '{_word[0]}' || chr(92) || '{_word[1:]}')"


@query(f"""
    WITH rows AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL VALUES {", ".join(f"({a}, {b}, '{c}', '{d}')" for a, b, c, d in PROBE)})
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
           coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
           sum({len(chat.START + chat.END) + 2} + length(replace({_ESCAPED.replace("@", "role")}, chr(10), chr(92) || 'n'))
               + length({_ESCAPED.replace("@", "text")}))::BIGINT AS formatted_chars
    FROM rows GROUP BY conv_id""")
def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as one text, and the digests of what is read back from it."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame(PROBE, "conv_id bigint, turn bigint, role string, text string")
    made = chat.formatted(chat.conversations(chat.chains(rows.unionByName(probe))))
    back = made.withColumn("back", chat.read_back(F.col("formatted"))).withColumn("loss", chat.loss_texts(F.col("formatted"), F.col("loss_spans")))
    turns = F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.array_join("loss", "")
    return back.select(
        F.col("tree_id").alias("conv_id"),
        F.size("back").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"),
        F.length(loss).cast("bigint").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


@query()
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item or an edited copy of one, with the alignment."""
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document."""
    return tokens.count_tokens(table(spark, sf_dir, "documents"))


@query()
def op5_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words the mix takes from every document."""
    return mixing.mix_sources(table(spark, sf_dir, "documents"))[1]


@query()
def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: the fixed kinds and the random strings the models add."""
    docs = table(spark, sf_dir, "documents")
    rows = secret_scan.scan(docs.select("doc_id", "text"), secret_scan.train(docs))
    base = F.filter("spans", lambda s: s["rank"] < 3)

    def count(rank: int):
        return F.size(F.filter("spans", lambda s: s["rank"] == rank)).cast("bigint")

    return rows.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(secret_scan.listed(base), 256).alias("base_sha256"), secret_scan.listed(F.col("spans")).alias("spans"),
    )


@query()
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; trained on labelled rows outside the fold."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(fold(5) == 0, F.lit(False)))
    model = quality.train(docs.filter(~F.col("held_out")), table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model, ["doc_id", "held_out"])
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.3, 1).otherwise(0))


@query()
def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return pages.extract(table(spark, sf_dir, "pages"))


@query("""
    WITH good AS (
      SELECT vec_id, list_transform(embedding, lambda x: floor(256.0 * x::DOUBLE)) AS v FROM embeddings
      WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    pairs AS (
      SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
      FROM good q JOIN good c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM pairs)
    SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""")
def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five largest inner products of every 50th vector with all others."""
    rows = table(spark, sf_dir, "embeddings").filter(nearest.usable(F.col("embedding")))
    vectors = rows.select("vec_id", nearest.quantized(F.col("embedding")).alias("v"))
    return nearest.top_k(vectors, vectors.filter("vec_id % 50 = 0"))


@query()
def op11_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document and the text they decode to, as digests."""
    return pieces.round_trip(table(spark, sf_dir, "documents"), ["doc_id"])


#: CRC-32 by its table ``tab``, over a list of bytes (@).
CRC_TABLE = """
  tab AS (
    SELECT list(c ORDER BY i) AS tab
    FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM range(256) r(i)))"""
CRC = "xor(list_reduce(@, lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"


def _repair_sql() -> str:
    """Damage, faults, and the best edits from each conversation's end to its start, for each of four states."""
    key = "coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')"
    crc = CRC.replace("@", f"list_transform(string_split({key}, ''), lambda x: ord(x)::BIGINT)")
    after = {0: 2, 1: 2, 2: 3, 3: 2}  # the state that a user or assistant row leads to
    role = {2: "user", 3: "assistant"}
    keeps = {0: "CASE i1 WHEN 's' THEN s1 WHEN 'u' THEN s2 END", 1: "CASE i1 WHEN 'u' THEN s2 END", 2: "CASE i1 WHEN 'a' THEN s3 END", 3: "CASE i1 WHEN 'u' THEN s2 END"}

    def way(cost: str, audit: str, out: str) -> str:
        return f"{{'c': ({cost})::BIGINT, 'a': {audit}, 'o': {out}}}"

    def over(p: int) -> str:
        q, kept = after[p], keeps[p]
        delete = way(f"3 + s{p}.c", f"'D' || s{p}.a", f"s{p}.o")
        change = way(f"2 + t + s{q}.c", f"'R' || s{q}.a", f"chr(10) || '{role[q]}:' || text || s{q}.o")
        keep = way(f"t + ({kept}).c", f"'K' || ({kept}).a", f"chr(10) || role || ':' || text || ({kept}).o")
        return f"list_min([{delete}, CASE WHEN NOT must THEN {change} END, CASE WHEN NOT must AND ({kept}) IS NOT NULL THEN {keep} END]) AS k{p}"

    def inserted(p: int) -> str:
        q, r = after[p], after[after[p]]
        one = way(f"2 + k{q}.c", f"'I' || k{q}.a", f"chr(10) || '{role[q]}:' || k{q}.o")
        two = way(f"4 + k{r}.c", f"'II' || k{r}.a", f"chr(10) || '{role[q]}:' || chr(10) || '{role[r]}:' || k{r}.o")
        return f"list_min([k{p}, {one}, {two}]) AS s{p}"

    ends = [way("0", "''", "''"), way("4", "'II'", "chr(10) || 'user:' || chr(10) || 'assistant:'"), way("2", "'I'", "chr(10) || 'assistant:'"), way("0", "''", "''")]
    return f"""WITH RECURSIVE {CRC_TABLE},
  raw AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS kind FROM conversations, tab),
  damaged AS (
    SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
           CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM (SELECT *, unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) FROM raw WHERE kind <> 0)),
  placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM damaged),
  seen AS (
    SELECT *, left(role, 1) AS i1, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank,
           row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS again,
           NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') AS cut,
           left(lag(role) OVER (PARTITION BY conv_id ORDER BY n), 1) AS before
    FROM placed),
  faults AS (SELECT *, blank OR again AS must, CASE WHEN cut AND NOT blank AND NOT again THEN 1 ELSE 0 END AS t FROM seen),
  counts AS (
    SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
           count_if(blank)::BIGINT AS blank, count_if(again AND NOT blank)::BIGINT AS duplicate, sum(t)::BIGINT AS truncated,
           count_if(before IS NOT NULL AND before || i1 NOT IN ('su', 'ua', 'au'))::BIGINT AS illegal
    FROM faults GROUP BY 1),
  walk AS (
    SELECT conv_id, n + 1 AS pos, {", ".join(f"{e} AS s{p}" for p, e in enumerate(ends))} FROM counts
    UNION ALL
    SELECT conv_id, pos, {", ".join(inserted(p) for p in range(4))}
    FROM (
      SELECT w.conv_id, w.pos - 1 AS pos, {", ".join(over(p) for p in range(4))}
      FROM walk w JOIN faults f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.n = w.pos - 1)),
  made AS (SELECT conv_id, s0 FROM walk WHERE pos = 1)
  SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
         coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(s0.c, 0)::BIGINT AS cost,
         coalesce(s0.a, '') AS audit, sha256(coalesce(substr(s0.o, 2), '')) AS repaired_sha256
  FROM (SELECT DISTINCT conv_id FROM conversations) c
  LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN made ON made.conv_id IS NOT DISTINCT FROM c.conv_id"""


@query(_repair_sql())
def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation damaged by rule and repaired: faults found, cost and edits, digest of the result."""
    return repair.repaired_digests(table(spark, sf_dir, "conversations"))


_BYTES = "list_transform(range(1, strlen(@) + 1), lambda i: ('0x' || substr(hex(encode(@)), 2 * i - 1, 2))::BIGINT)"
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@query(f"""WITH {CRC_TABLE},
  texts AS (
    SELECT true AS own, row_number() OVER () AS row, doc_id, text FROM documents
    UNION ALL SELECT false, row_number() OVER (), NULL, text FROM benchmark),
  words AS (
    SELECT own, row, regexp_extract_all(translate(coalesce(text, ''), '{_CAPITALS}', '{_SMALL}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM texts),
  grams AS (
    SELECT own, row, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS g FROM words),
  counted AS (SELECT own, row, g, count(*) AS n FROM grams GROUP BY ALL),
  coded AS (SELECT g, {CRC.replace("@", _BYTES.replace("@", "g"))} % 10000 AS b FROM (SELECT DISTINCT g FROM counted), tab),
  hashed AS (SELECT own, row, b, sum(n)::BIGINT AS n FROM counted JOIN coded USING (g) GROUP BY ALL),
  buckets AS (SELECT b, coalesce(sum(n) FILTER (own), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (NOT own), 0)::DOUBLE AS t FROM hashed GROUP BY 1),
  totals AS (SELECT sum(s) AS s_all, sum(t) AS t_all FROM buckets),
  gains AS (SELECT b, floor(1000 * ln((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000))))::BIGINT AS gain FROM buckets, totals),
  sums AS (SELECT row, sum(n)::BIGINT AS n, sum(n * gain)::BIGINT AS total FROM hashed JOIN gains USING (b) WHERE own GROUP BY 1),
  weights AS (
    SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce((total - ((total % n) + n) % n) // n, 0)::BIGINT AS weight,
           ('0x' || left(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 8))::BIGINT AS h
    FROM texts LEFT JOIN sums USING (row) WHERE own),
  scored AS (SELECT doc_id, n_features, weight, (weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score FROM weights),
  ranked AS (
    SELECT *, row_number() OVER (PARTITION BY n_features >= 39 ORDER BY score DESC, doc_id NULLS LAST, n_features) AS r,
           count(*) OVER (PARTITION BY n_features >= 39) AS n FROM scored)
  SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 39 AND r <= 25 * n // 100 THEN r END AS rank FROM ranked""")
def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of every document in a draw towards the benchmark's texts."""
    rows = resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.drop("n_words")
