"""The registered queries of the numbered operators, over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .alignment import align_tokenizers
from .chat_format import conversation_events, digest_formatted, fold_events, render_messages
from .collocations import collocations
from .decontamination import find_benchmark
from .embedding_dedup import near_duplicates
from .language_id import predict_language
from .license_scan import scan_licenses
from .lm_scoring import score_documents
from .mixing import mix_sources
from .ngram_join import near_copies
from .packing import pack_documents
from .token_counts import count_tokens
from .toxicity import score_toxicity

CONTROL_TURN = "</s>[INST] ok [/INST]"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "embeddings"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict_language(_table(spark, sf_dir, "documents"))


def op3_bestfit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(_table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return count_tokens(docs, tokenizer_file("byte_bpe_50k.json")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", CONTROL_TURN), (-1, 1, "assistant", CONTROL_TURN)], rows.schema)
    messages = fold_events(conversation_events(rows.unionByName(extra)))
    return digest_formatted(render_messages(messages))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(_table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_benchmark(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"))


def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents"))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_language_id": op2_language_id,
    "op3_bestfit_packing": op3_bestfit_packing,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_token_counts": op5_token_counts,
    "op6_chat_format": op6_chat_format,
    "op7_ngram_join": op7_ngram_join,
    "op8_decontamination": op8_decontamination,
    "op9_license_scan": op9_license_scan,
    "op10_toxicity": op10_toxicity,
    "op11_collocations": op11_collocations,
    "op12_source_mixing": op12_source_mixing,
    "op13_tokenizer_alignment": op13_tokenizer_alignment,
}

ORACLE_SQL: dict[str, str] = {
    "op1_embedding_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), links AS (
            SELECT a.vec_id AS a, b.vec_id AS b
            FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
            WHERE list_cosine_similarity(a.e, b.e) >= 0.98
        ), reach AS (
            SELECT vec_id AS a, vec_id AS b FROM embeddings
            UNION
            SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
        ), least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
        n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
        SELECT e.vec_id, CAST(coalesce(n.n_links, 0) AS BIGINT) AS n_links, least.component_id,
               e.vec_id = least.component_id AS kept
        FROM embeddings e JOIN least ON least.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id
    """,
    "op6_chat_format": r"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
        ), e AS (
            SELECT *, regexp_replace(text, '(\\|\[INST\]|<<SYS>>|\[/INST\]|\[ROLE\]|\[/ROLE\]|</s>|<s>|<</SYS>>)', '\\\1', 'g') AS escaped,
                   regexp_replace(role, '(\\|\[INST\]|<<SYS>>|\[/INST\]|\[ROLE\]|\[/ROLE\]|</s>|<s>|<</SYS>>)', '\\\1', 'g') AS escaped_role
            FROM t
        ), l AS (
            SELECT conv_id, count(*) AS n_turns,
                   sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
                   coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
                   sum(length(escaped) + 4 + CASE role WHEN 'user' THEN 6 WHEN 'system' THEN 7 WHEN 'assistant' THEN 7
                       ELSE 13 + length(escaped_role) END) AS formatted_chars
            FROM e GROUP BY conv_id
        )
        SELECT conv_id, n_turns, turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
               CAST(formatted_chars AS BIGINT) AS formatted_chars
        FROM l
    """,
    "op8_decontamination": """
        WITH d AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS w FROM documents
        ), b AS (
            SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS w FROM benchmark
        ), ds AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))
                WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d
        ), bs AS (
            SELECT DISTINCT item_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))
                WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM b
        ), n AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY item_id),
        m AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN bs USING (s) GROUP BY doc_id, item_id)
        SELECT doc_id, item_id, n_item, n_shared, n_shared / n_item AS containment
        FROM m JOIN n USING (item_id) WHERE n_shared >= n_item * 0.8 - 1e-9
    """,
    "op7_ngram_join": """
        WITH RECURSIVE d AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' '))
                WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d
        ), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        m AS MATERIALIZED (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
        links AS MATERIALIZED (
            SELECT a, b FROM m JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 90 * (na.n + nb.n - i)
        ), reach AS (
            SELECT doc_id AS a, doc_id AS b FROM documents
            UNION
            SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
        )
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.component_id
        FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON r.a = d.doc_id
    """,
    "op11_collocations": """
        WITH p AS (
            SELECT lang, row_number() OVER () AS piece, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda w: w <> '') AS w FROM (
                SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                    '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)
        ), n AS (SELECT lang, sum(len(w)) AS n FROM p GROUP BY lang),
        g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])) AS g FROM p, (SELECT unnest(range(1, 6)) AS k)),
        f AS MATERIALIZED (SELECT lang, k, g, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
        c AS (SELECT f.lang, f.k, f.g, f.f AS a, cut, x.f AS l, y.f AS r, n.n, CAST(1000::HUGEINT * f.f * n.n // (x.f::HUGEINT * y.f) AS BIGINT) AS score
            FROM f JOIN (SELECT unnest(range(1, 5)) AS cut) ON cut < f.k JOIN f x ON x.lang = f.lang AND x.g = f.g[1:cut] JOIN f y ON y.lang = f.lang AND y.g = f.g[cut + 1:]
            JOIN n ON n.lang = f.lang),
        b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1),
        inside AS (SELECT lang, unnest([g[1:k - 1], g[2:]]) AS g, f FROM f WHERE k > 2),
        kept AS (SELECT b.lang, array_to_string(b.g, ' ') AS phrase, a, l, r, n, score FROM b
            WHERE NOT EXISTS (FROM inside i WHERE i.lang = b.lang AND i.g = b.g AND 100 * i.f >= 100 * b.a))
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM kept QUALIFY rank <= 2000
    """,
    "op12_source_mixing": """
        WITH d AS (
            SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
                CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15) AS BIGINT) AS h FROM documents
        ), s AS (SELECT source, sum(size)::BIGINT AS ss FROM d GROUP BY source),
        w AS (SELECT *, 1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS w FROM s),
        o AS (SELECT *, sum(ss) OVER () AS total, sum(w) OVER (ORDER BY ss * 6 // w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w,
            coalesce(sum(ss) OVER (ORDER BY ss * 6 // w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM w),
        u AS (SELECT *, 3 * ss * open_w < w * (total - 3 * before) AS above FROM o),
        v AS (SELECT CAST(sum(ss) - 3 * coalesce(sum(ss) FILTER (above), 0) AS BIGINT) AS left_, CAST(coalesce(sum(w) FILTER (NOT above), 1) AS BIGINT) AS share FROM u),
        t AS (SELECT source, ss, CASE WHEN above THEN CAST(3 * ss AS DOUBLE) ELSE CAST(w * left_ AS DOUBLE) / share END AS target, CASE WHEN above THEN 3 * ss ELSE w * left_ // share END AS budget FROM u, v),
        q AS (SELECT *, CASE WHEN ss > 0 THEN budget // ss ELSE 0 END AS whole, CASE WHEN ss > 0 THEN budget % ss ELSE 0 END AS rest FROM t),
        g AS (SELECT source, h, sum(size) AS gs, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) AS upto FROM d GROUP BY source, h)
        SELECT d.doc_id, d.size, q.ss AS source_size, q.target, CAST(d.size * q.whole + CASE WHEN upto <= rest THEN d.size WHEN upto - gs < rest THEN d.size * (rest - (upto - gs)) // gs ELSE 0 END AS BIGINT) AS taken
        FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source JOIN g ON g.source IS NOT DISTINCT FROM d.source AND g.h = d.h
    """,
}
