"""The queries of this subpackage and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwright.llm import bpe, chat, packing, pieces, quality, ranked, repair, search, simhash, substrings, suffixes, urls, vectors
from shelfwright.llm.scratch import Scratch
from shelfwright.plans.registry import Query, table
from shelfwright.session import configure

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(configure(spark), sf_dir)

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[fn.__name__] = run
        if sql is not None:
            SQL[fn.__name__] = sql.strip()
        return fn

    return register


@query(
    """
    WITH RECURSIVE v AS (
      SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e,
        label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
          AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
          AND len([x FOR x IN embedding IF x <> 0]) > 0 AS good
      FROM embeddings
    ), n AS (SELECT *, sqrt(list_inner_product(e, e)) AS norm FROM v WHERE good),
    links AS (
      SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id
        AND len(a.e) = len(b.e)
      WHERE list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.98
    ), reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
    SELECT v.vec_id, coalesce(k.n, 0) AS n_links, least(v.vec_id, coalesce(m.b, v.vec_id)) AS component_id,
      v.vec_id = least(v.vec_id, coalesce(m.b, v.vec_id)) AS kept
    FROM v LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) k ON k.a = v.vec_id
    LEFT JOIN (SELECT a, min(b) AS b FROM reach GROUP BY a) m ON m.a = v.vec_id
    """
)
def op10_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"), 0.98)


@query()
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_texts(table(spark, sf_dir, "documents"), distance=4, words=4)


@query(
    r"""
    WITH b AS (SELECT doc_id, encode(coalesce(text, '')) AS t, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
    win AS (
      SELECT doc_id, i, md5(t[i:i + 199]) AS h FROM (SELECT doc_id, t, unnest(range(1, n - 198)) AS i FROM b WHERE n >= 200)
    ), rep AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
    hit AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS gap FROM win WHERE h IN (SELECT h FROM rep)),
    grp AS (SELECT *, sum(CASE WHEN gap <= 200 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM hit),
    span AS (SELECT doc_id, min(i) AS s, max(i) + 200 AS e FROM grp GROUP BY doc_id, g),
    edge AS (
      SELECT doc_id, s, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 1) AS from_, s - 1 AS to_ FROM span
      UNION ALL SELECT b.doc_id, max(n) + 1, coalesce(max(e), 1), max(n) FROM b LEFT JOIN span USING (doc_id) GROUP BY b.doc_id
    ), kept AS (
      SELECT doc_id, string_agg(CASE WHEN to_ >= from_ THEN hex(t[from_:to_]) ELSE '' END, '' ORDER BY s) AS x
      FROM edge JOIN b USING (doc_id) GROUP BY doc_id
    ), total AS (SELECT doc_id, sum(e - s) AS gone, count(*) AS n_spans FROM span GROUP BY doc_id)
    SELECT b.doc_id, n AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
      sha256(unhex(x)) AS kept_sha256
    FROM b JOIN kept USING (doc_id) LEFT JOIN total USING (doc_id)
    """
)
def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"), size=200).select(
        "row.doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query(
    r"""
    WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    win AS (
      SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS h
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)
    ), rep AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
    cov AS (SELECT DISTINCT doc_id, i + unnest(range(35)) AS j FROM win WHERE h IN (SELECT h FROM rep)),
    gone AS (SELECT doc_id, count(*) AS n FROM cov GROUP BY doc_id),
    kept AS (
      SELECT e.doc_id, string_agg(word, ' ' ORDER BY j) AS t
      FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM w) e ANTI JOIN cov USING (doc_id, j)
      GROUP BY e.doc_id
    )
    SELECT w.doc_id, len(ws) AS n_words, coalesce(gone.n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
    FROM w LEFT JOIN gone ON gone.doc_id = w.doc_id LEFT JOIN kept ON kept.doc_id = w.doc_id
    """
)
def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_spans(table(spark, sf_dir, "documents"), size=35).select(
        "row.doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")
    )


@query()
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), limit=2048)


@query(
    r"""
    WITH t AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
      UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
    ), e AS (
      SELECT *, 4 + 2 + 8
        + length(replace(replace(replace(replace(role, '\', '\\'), '### ', '#\## '), ':' || chr(10), ':\' || chr(10)), '</turn>', '<\/turn>'))
        + length(replace(replace(replace(replace(text, '\', '\\'), '### ', '#\## '), ':' || chr(10), ':\' || chr(10)), '</turn>', '<\/turn>'))
        AS chars
      FROM t
    )
    SELECT conv_id, count(*) AS n_turns,
      sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
      CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
      sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
      CAST(sum(chars) AS BIGINT) AS formatted_chars
    FROM e GROUP BY conv_id
    """
)
def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame(
        [(-7, 0, "user", own), (-7, 1, "assistant", own)], "conv_id long, turn long, role string, text string"
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.read_back(chat.format_chats(turns))


URL_RULES = (
    urls.Rule("com/", "allow"), urls.Rule("example.com/en/", "block"), urls.Rule("www.example.com/en/", "allow"),
    urls.Rule("net/es/", "block"), urls.Rule("net/fr/", "block"), *urls.DEFAULT_RULES,
)


@query(
    f"""
    WITH s AS (SELECT page_id, coalesce(url, '') AS url, strpos(coalesce(url, ''), '://') AS p FROM pages),
    r AS (SELECT page_id, CASE WHEN p > 0 THEN substr(url, p + 3) ELSE '' END AS rest FROM s),
    h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS host FROM r),
    u AS (
      SELECT page_id, translate(host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(substr(rest, length(host) + 1), '^[^?#]*') AS path
      FROM h
    ), rules(text, host, path, verdict) AS (VALUES
      ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'),
      ('www.example.com/en/', 'www.example.com', '/en/', 'allow'), ('net/es/', 'net', '/es/', 'block'),
      ('net/fr/', 'net', '/fr/', 'block')
    ), m AS (
      SELECT u.page_id, max_by(rules.text, length(rules.text)) AS text, max_by(rules.verdict, length(rules.text)) AS verdict
      FROM u JOIN rules ON (u.host = rules.host OR u.host LIKE '%.' || rules.host) AND starts_with(u.path, rules.path)
      GROUP BY u.page_id
    )
    SELECT u.page_id, u.host, u.path, m.text AS rule,
      coalesce(m.verdict, CASE WHEN regexp_matches(u.host || u.path,
        '(^|[^0-9A-Za-z])({"|".join(urls.UNWANTED)})([^0-9A-Za-z]|$)') THEN 'block' ELSE 'allow' END) AS verdict
    FROM u LEFT JOIN m ON m.page_id = u.page_id
    """
)
def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES)


@query()
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)
    return scored.select("row.doc_id", "held_out", "score", "predicted")


@query(
    r"""
    WITH w AS (
      SELECT doc_id, unnest(regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')) AS term
      FROM documents
    ), tf AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY doc_id, term),
    dl AS (SELECT doc_id, count(*) AS dl FROM w GROUP BY doc_id),
    n AS (SELECT count(*) AS n, (SELECT count(*) FROM w) / count(*) AS avgdl FROM documents),
    idf AS (SELECT term, ln(1 + (any_value(n.n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, n GROUP BY term),
    s AS (
      SELECT q.doc_id AS query_id, d.doc_id, round(sum(idf * d.tf * 2.2 / (d.tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score
      FROM tf q JOIN tf d ON q.term = d.term JOIN idf ON idf.term = d.term JOIN dl ON dl.doc_id = d.doc_id, n
      WHERE q.doc_id % 50 = 0 GROUP BY q.doc_id, d.doc_id
    ), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s)
    SELECT query_id, doc_id, rank, score FROM r WHERE rank <= 10
    """
)
def op2_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return search.top_documents(docs, F.col("doc_id") % 50 == 0, k=10)


@query()
def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op4")
    coded = scratch.save(pieces.encode(table(spark, sf_dir, "documents")), "ids")
    # digests are made before the join, so it moves neither ids nor texts
    back = pieces.decode(coded).select("row_number", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))
    digests = coded.select(
        "row_number", "doc_id", F.size("ids").cast("long").alias("n_ids"),
        F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"),
    )
    return digests.join(back, "row_number").drop("row_number")


@query()
def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "documents").select("doc_id", bpe.encode(F.col("text")).alias("ids"))
    return ids.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(bpe.decode(F.col("ids")).cast("binary"), 256).alias("decoded_sha256"),
    )


@query(
    r"""
    WITH d AS (
      SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws
      FROM documents
    ), q AS (
      SELECT DISTINCT item_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws
      FROM benchmark
    ), qt AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(ws) AS term FROM q) GROUP BY item_id, term),
    tf AS (SELECT doc_id, r, term, count(*) AS tf FROM (SELECT doc_id, r, unnest(ws) AS term FROM d) GROUP BY doc_id, r, term),
    n AS (SELECT count(*) AS n, CAST(sum(len(ws)) AS BIGINT) AS l FROM d WHERE len(ws) > 0),
    m AS (SELECT r, 100 - 75 + ((75 * len(ws) * n.n) // n.l) AS m FROM d, n WHERE len(ws) > 0),
    w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n.n) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, n GROUP BY term),
    s AS (
      SELECT item_id, doc_id, tf.r, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
      FROM qt JOIN tf USING (term) JOIN w USING (term) JOIN m ON m.r = tf.r GROUP BY item_id, doc_id, tf.r
    ), k AS (
      SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0
    )
    SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10
    """
)
def op13_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


@query(
    r"""
    WITH RECURSIVE bits(i, n, x) AS (
      SELECT i, 0, CAST(i AS BIGINT) FROM range(256) t(i)
      UNION ALL SELECT i, n + 1, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END FROM bits WHERE n < 8
    ), tab AS (SELECT list(x ORDER BY i) AS t FROM bits WHERE n = 8),
    src AS (
      SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k
      FROM conversations
    ), hit AS (
      SELECT src.* EXCLUDE (k), xor(list_reduce(list_prepend(4294967295, [CAST(ord(c) AS BIGINT) FOR c IN string_split(k, '')]),
        lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 20 AS c
      FROM src, tab
    ), rows_ AS (
      SELECT conv_id, turn, CASE WHEN c = 4 THEN 'user' ELSE role END AS role,
        CASE c WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(range(CASE c WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
      FROM hit
    ), o AS (
      SELECT coalesce(CAST(conv_id AS VARCHAR), 'null') AS cv, *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS cut,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i,
        row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen,
        count(*) OVER (PARTITION BY conv_id) AS n
      FROM rows_
    ), e AS (
      SELECT *, cut = '' OR seen > 1 AS bad, CASE WHEN right(cut, 1) IN ('.', '!', '?') THEN 0 ELSE 1 END AS t, role[1] AS c,
        lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) AS before_
      FROM o
    ), b(cv, i, b0, b1, b2, b3) AS (
      SELECT cv, n + 1, 0, 4, 2, 0 FROM e WHERE i = 1
      UNION ALL
      SELECT cv, i, least(x0, 2 + x2, 4 + x3), least(x1, 2 + x2, 4 + x3), least(x2, 2 + x3), least(x3, 2 + x2) FROM (
        SELECT e.cv, e.i,
          least(3 + b0, CASE WHEN bad THEN 99999999 ELSE t + least(2 + b2, CASE c WHEN 's' THEN b1 WHEN 'u' THEN b2 ELSE 99999999 END) END) AS x0,
          least(3 + b1, CASE WHEN bad THEN 99999999 ELSE t + least(2 + b2, CASE c WHEN 'u' THEN b2 ELSE 99999999 END) END) AS x1,
          least(3 + b2, CASE WHEN bad THEN 99999999 ELSE t + least(2 + b3, CASE c WHEN 'a' THEN b3 ELSE 99999999 END) END) AS x2,
          least(3 + b3, CASE WHEN bad THEN 99999999 ELSE t + least(2 + b2, CASE c WHEN 'u' THEN b2 ELSE 99999999 END) END) AS x3
        FROM b JOIN e ON e.cv = b.cv AND e.i = b.i - 1
      )
    ), v AS (SELECT cv, i, [b0, b1, b2, b3] AS b FROM b),
    f(cv, i, q, audit, lines, done) AS (
      SELECT cv, CAST(1 AS BIGINT), 0, '', CAST([] AS VARCHAR[]), false FROM e WHERE i = 1
      UNION ALL
      SELECT cv, i + CASE WHEN edit IN ('I', '') THEN 0 ELSE 1 END,
        CASE edit WHEN '' THEN q WHEN 'D' THEN q WHEN 'K' THEN CASE c WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END ELSE CASE q WHEN 2 THEN 3 ELSE 2 END END,
        audit || edit,
        CASE edit WHEN '' THEN lines WHEN 'D' THEN lines WHEN 'K' THEN list_append(lines, role || ':' || text)
          ELSE list_append(lines, CASE q WHEN 2 THEN 'assistant' ELSE 'user' END || ':' || CASE edit WHEN 'R' THEN text ELSE '' END) END,
        edit = ''
      FROM (
        SELECT f.*, e.role, e.text, e.c, CASE
          WHEN e.i IS NULL THEN CASE WHEN here.b[q + 1] = 0 THEN '' ELSE 'I' END
          WHEN 3 + next.b[q + 1] = here.b[q + 1] THEN 'D'
          WHEN 2 + here.b[CASE q WHEN 2 THEN 4 ELSE 3 END] = here.b[q + 1] THEN 'I'
          WHEN NOT bad AND t + CASE WHEN e.c = 's' AND q = 0 THEN next.b[2] WHEN e.c = 'u' AND q <> 2 THEN next.b[3]
            WHEN e.c = 'a' AND q = 2 THEN next.b[4] ELSE 99999999 END = here.b[q + 1] THEN 'K'
          ELSE 'R' END AS edit
        FROM f JOIN v AS here ON here.cv = f.cv AND here.i = f.i LEFT JOIN e ON e.cv = f.cv AND e.i = f.i
          LEFT JOIN v AS next ON next.cv = f.cv AND next.i = f.i + 1
        WHERE NOT done
      )
    ), s AS (
      SELECT cv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (cut = '') AS blank,
        count(*) FILTER (cut <> '' AND seen > 1) AS duplicate, count(*) FILTER (NOT bad AND t = 1) AS truncated,
        count(*) FILTER (i > 1 AND before_ || c NOT IN ('su', 'ua', 'au')) AS illegal
      FROM e GROUP BY cv
    )
    SELECT g.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
      coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(CAST(v.b[1] AS BIGINT), 0) AS cost,
      coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id, coalesce(CAST(conv_id AS VARCHAR), 'null') AS cv FROM conversations) g
      LEFT JOIN s ON s.cv = g.cv LEFT JOIN v ON v.cv = g.cv AND v.i = 1 LEFT JOIN (SELECT * FROM f WHERE done) f ON f.cv = g.cv
    """
)
def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    made = repair.Repair(repair.damage(turns))
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    summary, digests = made.summary(), made.digests()
    every = turns.select(F.col("conv_id").alias("id")).distinct()
    return (
        every.join(summary, F.col("id").eqNullSafe(F.col("conv_id")), "left").drop("conv_id")
        .join(digests, F.col("id").eqNullSafe(F.col("conv_id")), "left")
        .select(
            F.col("id").alias("conv_id"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts],
            F.coalesce("audit", F.lit("")).alias("audit"),
            F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
        )
    )
