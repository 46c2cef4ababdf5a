"""The operators of this subpackage as queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, codes, embeddings, exact, hmm, langid, mixing, passages, repair, secrets, simhash, sketches, token_files
from tessera.llm.common import documents


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(documents(spark, sf_dir)))


def op2_shared_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.shared_passages(documents(spark, sf_dir))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read_tokens(spark, token_files.write_tokens(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json")))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.tiktoken"), tokenizer_pattern())


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_report(documents(spark, sf_dir))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(documents(spark, sf_dir))


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(documents(spark, sf_dir))


def op9_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score_documents(documents(spark, sf_dir))


def op11_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.fingerprints(documents(spark, sf_dir))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_report(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_secret_scan, op2_shared_passages, op3_token_files, op4_byte_bpe, op5_language, op6_exact_dedup, op7_simhash, op8_mix, op9_near_vectors, op10_language_model, op11_sketches, op12_repair, op13_vector_codes)
}

def _repair_sql() -> str:
    """Conversation repair turn by turn in a recursive query; a state is a struct of cost, audit and repaired lines."""

    def more(s: str, cost: str, edit: str, line: str | None = None) -> str:
        lines = f"list_append({s}.t, {line})" if line else f"{s}.t"
        return f"{{'c': {s}.c + {cost}, 'a': {s}.a || {edit}, 't': {lines}}}"

    def least(*states: str) -> str:
        return f"list_min([{', '.join(states)}])"

    def insert(s: str, role: str) -> str:
        return more(s, "2", "'I'", f"'{role}:'")

    def give(s: str, role: str) -> str:
        right = f"(i = '{role[0]}')"
        return more(s, f"CASE WHEN {right} THEN 0 ELSE 2 END + stay", f"CASE WHEN {right} THEN 'K' ELSE 'R' END", f"CASE WHEN {right} THEN role ELSE '{role}' END || ':' || text")

    far = "{'c': 1000000000, 'a': '', 't': []::VARCHAR[]}"
    start = f"{{'c': 0, 'a': '', 't': []::VARCHAR[]}} AS s0, {far} AS s1, {far} AS s2, {far} AS s3"
    system = more("s0", "CASE WHEN i = 's' THEN 0 ELSE 1000000000 END + stay", "'K'", "role || ':' || text")
    user = least("s2", *(insert(s, "user") for s in ("s0", "s1", "s3")))
    assistant = least("s3", insert("s2", "assistant"), *(insert(f"({insert(s, 'user')})", "assistant") for s in ("s0", "s1")))
    drop = lambda s: more(s, "3", "'D'")  # noqa: E731
    return rf"""
        WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
            [unicode(c)::BIGINT for c in string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), '')] AS bytes FROM conversations),
        l AS (SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295, bytes), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))) % 20 AS lot FROM k),
        d AS (SELECT conv_id, turn, CASE WHEN lot = 4 THEN 'user' ELSE role END AS role,
            CASE WHEN lot = 1 THEN '' WHEN lot = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE lot WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) FROM l),
        n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(length(role)::VARCHAR || ':' || role || text)) AS n FROM d),
        o AS (SELECT *, left(role, 1) AS i, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) AS before,
            CASE WHEN NOT regexp_matches(text, '[^ 	-]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'd'
                WHEN NOT regexp_matches(text, '[.!?][ 	-]*\z') THEN 't' ELSE '' END AS fault FROM n),
        f AS MATERIALIZED (SELECT *, CASE fault WHEN 'b' THEN 1000000000 WHEN 'd' THEN 1000000000 WHEN 't' THEN 1 ELSE 0 END AS stay FROM o),
        r AS (SELECT conv_id, 0::BIGINT AS n, {start} FROM (SELECT DISTINCT conv_id FROM f)
            UNION ALL SELECT conv_id, n, {drop("s0")}, {least(drop("s1"), system)}, {least(drop("u"), give("s0", "user"), give("s1", "user"), give("v", "user"))}, {least(drop("v"), give("u", "assistant"))}
            FROM (SELECT f.*, s0, s1, {user} AS u, {assistant} AS v FROM r JOIN f ON r.conv_id IS NOT DISTINCT FROM f.conv_id AND f.n = r.n + 1)),
        t AS (SELECT conv_id, {least("s0", "s3", insert("s2", "assistant"), insert(f"({insert('s1', 'user')})", "assistant"))} AS best FROM r QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC) = 1),
        g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
            count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (before || i NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
        SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
            coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(array_to_string(best.t, chr(10)), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) e LEFT JOIN g ON e.conv_id IS NOT DISTINCT FROM g.conv_id LEFT JOIN t ON e.conv_id IS NOT DISTINCT FROM t.conv_id
    """


def _codes_sql(rounds: int = 4) -> str:
    """Four rounds of nearest entries and means, each a table of its own."""

    def assigned(n: int) -> str:
        near = f"min({{'d': list_inner_product(p.x, p.x) - 2 * list_inner_product(p.x, b.x) + list_inner_product(b.x, b.x), 'e': b.e}})"
        return f"a{n} AS MATERIALIZED (SELECT id, p.part, {near} AS best FROM p JOIN b{n} b ON p.part = b.part GROUP BY id, p.part)"

    def means(n: int) -> str:
        return f"""m{n} AS (SELECT part, e, list(v ORDER BY i) AS x FROM (SELECT p.part, best.e AS e, i, floor(sum(p.x[i]) / count(*)) AS v
            FROM p JOIN a{n - 1} a ON p.id = a.id AND p.part = a.part, (SELECT unnest(range(1, (SELECT max(len(x)) FROM p) + 1)) AS i) GROUP BY p.part, best.e, i) GROUP BY part, e),
        b{n} AS MATERIALIZED (SELECT b.part, b.e, coalesce(m.x, b.x) AS x FROM b{n - 1} b LEFT JOIN m{n} m ON b.part = m.part AND b.e = m.e)"""

    steps = ", ".join(f"{assigned(n)}, {means(n + 1)}" for n in range(rounds))
    return f"""
        WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS id, vec_id, label, [floor(1024 * x::DOUBLE) for x in embedding] AS v
            FROM embeddings WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
        p AS MATERIALIZED (SELECT id, part, list_slice(v, part * len(v) // 4 + 1, (part + 1) * len(v) // 4) AS x FROM k, range(4) AS r(part)),
        b0 AS MATERIALIZED (SELECT part, id - 1 AS e, x FROM p WHERE id <= 256), {steps}, {assigned(rounds)},
        h AS (SELECT sha256(string_agg(array_to_string([c::BIGINT for c in x], ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM b{rounds}),
        c AS (SELECT id, string_agg(printf('%02x', best.e), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM a{rounds} GROUP BY id)
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM k JOIN c USING (id), h
    """


ORACLE: dict[str, str] = {
    "op12_repair": _repair_sql(),
    "op13_vector_codes": _codes_sql(),
    "op6_exact_dedup": r"""
        WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
        g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM d)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
    """,
    "op9_near_vectors": """
        WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
        l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
        r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
        c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
        n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
        SELECT e.vec_id, coalesce(n_links, 0) AS n_links, component_id, e.vec_id = component_id AS kept
        FROM embeddings e JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)
    """,
}
