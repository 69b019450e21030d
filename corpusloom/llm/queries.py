"""Registered queries of the training-data operators, one for each, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, dartminhash, decontam, langid, licenses, linededup, maintext, merkle, packing, quality, rules, toxicity, warc
from .common import Scratch, held_out, table


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.tokenize_and_pack(docs).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = rules.apply_policy(rules.ledger(table(spark, sf_dir, "documents"), keep=["doc_id"]), rules.PROSE)
    base = F.col("fail_bits").bitwiseAND(F.lit(rules.BASE.mask)) != 0
    return entries.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (F.col("kept") & ~base).alias("kept"), "fail_bits")


def quality_rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each rule of the policy of op9: what it rejects, what it alone rejects, and what is kept with and without it."""
    return rules.ablations(rules.ledger(table(spark, sf_dir, "documents"), keep=["doc_id"]), rules.PROSE)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(~held_out("doc_id")))
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lost = linededup.removals(docs, least_words=1)
    text = F.coalesce("text", F.lit(""))
    n_lines = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    keys = docs.select("doc_id", linededup.document_key("doc_id").alias("_id"), linededup.text_key("text").alias("_hash"), n_lines.cast("long").alias("n_lines"))
    removed = F.coalesce("_removed", F.array().cast("array<int>"))
    return keys.join(lost, ["_id", "_hash"], "left").select("doc_id", "n_lines", F.size(removed).cast("long").alias("n_removed"), F.array_join(removed.cast("array<string>"), ",").alias("removed_lines"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    forest = quality.train(docs, table(spark, sf_dir, "labels").where(~held_out("doc_id")))
    scored = quality.score(docs, forest)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dartminhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    base, method = F.array_distinct(F.col("spans.label")), F.array_distinct(F.col("blocks.label"))
    starts = F.col("spans.first_word")
    some = F.size("spans") > 0
    return found.select(
        "doc_id",
        "n_words",
        F.size("spans").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, method)), ",").alias("labels"),
        F.greatest(F.when(some, F.lit(1.0)).otherwise(F.lit(0.0)), F.coalesce(F.array_max(F.col("blocks.containment")), F.lit(0.0))).alias("score"),
    )


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    archive = f"{Scratch(spark, 'warc').path}/archive"
    warc.write(pages, archive)
    kind = pages.schema["page_id"].dataType
    return warc.read(spark, archive).select(F.col("source_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels").where(~held_out("doc_id")))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return maintext.extract(pages, maintext.train(pages), keep=["url"])


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    audited = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    text = F.when(audited, merkle.lower_ascii(F.col("text"))).otherwise(F.col("text"))
    found = merkle.manifest(docs, presented={"text": text}).withColumn("folded_root", merkle.fold(F.col("presented"), F.col("steps")))
    return found.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(merkle.proof(F.col("steps")).cast("binary"), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_line_dedup": op2_line_dedup,
    "op3_quality": op3_quality,
    "op4_near_dedup": op4_near_dedup,
    "op5_licenses": op5_licenses,
    "op6_warc": op6_warc,
    "op7_toxicity": op7_toxicity,
    "op8_packing": op8_packing,
    "op9_quality_rules": op9_quality_rules,
    "op10_decontamination": op10_decontamination,
    "op11_main_text": op11_main_text,
    "op12_collocations": op12_collocations,
    "op13_merkle_manifest": op13_merkle_manifest,
    "quality_rule_ablations": quality_rule_ablations,
}

def _license_sql() -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    listed = lambda words: "[" + ", ".join(map(quote, words)) + "]::VARCHAR[]"
    templates = ", ".join(f"({i}, {quote(label)}, {quote(text)}, {listed(needed)})" for i, (label, text, needed) in enumerate(licenses.TEMPLATES))
    phrases = ", ".join(f"({quote(label)}, {quote(text)})" for text, label in licenses.PHRASES)
    cls = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    split = lambda c: f"regexp_extract_all(translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{cls}')"
    return f"""
WITH d AS (SELECT doc_id, {split("coalesce(text, '')")} AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i FROM d),
p AS (SELECT label, string_split(phrase, ' ') AS pw FROM (VALUES {phrases}) AS v(label, phrase)),
s AS (SELECT w.doc_id, w.i, p.label FROM w JOIN p ON w.w = p.pw[1] JOIN d ON d.doc_id = w.doc_id
      WHERE list_slice(d.ws, w.i + 1, w.i + len(p.pw)) = p.pw),
b AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word,
             string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels, list(DISTINCT label) AS found FROM s GROUP BY doc_id),
t AS (SELECT id, label, unnest(list_distinct({split("body")})) AS w, len(list_distinct({split("body")})) AS size, len({split("body")}) AS n, needed FROM (VALUES {templates}) AS v(id, label, body, needed)),
k AS (SELECT w.doc_id, t.id, t.label, t.size, t.needed, w.w, unnest([w.i // t.n, w.i // t.n - 1]) AS block FROM w JOIN t ON w.w = t.w),
c AS (SELECT doc_id, id, label, block, count(DISTINCT w) / any_value(size) AS share FROM k WHERE block >= 0
      GROUP BY doc_id, id, label, block, size HAVING count(DISTINCT w) >= ceil(0.8 * any_value(size) - 1e-9) AND list_has_all(list(DISTINCT w), any_value(needed))),
m AS (SELECT doc_id, list(DISTINCT label) AS found, max(share) AS share FROM c GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(b.n_base, 0) AS BIGINT) AS n_base,
       CAST(b.first_word AS BIGINT) AS first_word, CAST(b.last_word AS BIGINT) AS last_word, coalesce(b.base_labels, '') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(b.found, []), coalesce(m.found, [])))), ',') AS labels,
       greatest(CASE WHEN b.n_base > 0 THEN 1.0 ELSE 0.0 END, coalesce(m.share, 0.0)) AS score
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN m USING (doc_id)
"""


def _merkle_sql(levels: int = 6) -> str:
    """Trees of up to 16^levels leaves; a finished tree goes up as it is."""

    def tree(name: str, leaves: str) -> str:
        """CTEs name0.. with the nodes of each level and name_run0.. with the runs."""
        parts = [f"{name}0 AS ({leaves})"]
        for k in range(levels):
            parts.append(f"{name}_run{k} AS (SELECT g, idx // 16 AS idx, list(digest ORDER BY idx) AS run, any_value(n) AS n FROM {name}{k} GROUP BY g, idx // 16)")
            parts.append(f"{name}{k + 1} AS (SELECT g, idx, CASE WHEN n = 1 THEN run[1] ELSE sha256(array_to_string(run, '')) END AS digest, (n + 15) // 16 AS n FROM {name}_run{k})")
        return ",\n".join(parts)

    def walk(name: str, runs: str, start: str) -> str:
        """CTEs name0.. that carry proof and folded up the levels of a tree."""
        parts = [f"{name}0 AS ({start})"]
        for k in range(levels):
            before, after = "array_to_string(run[1:CAST(w.idx % 16 AS INT)], '')", "array_to_string(run[CAST(w.idx % 16 AS INT) + 2:], '')"
            parts.append(
                f"{name}{k + 1} AS (SELECT w.* EXCLUDE (idx, proof, folded), w.idx // 16 AS idx, CASE WHEN r.n = 1 THEN proof ELSE concat(proof, {before}, {after}) END AS proof, "
                f"CASE WHEN r.n = 1 THEN folded ELSE sha256(concat({before}, folded, {after})) END AS folded FROM {name}{k} w JOIN {runs}_run{k} r ON w.g = r.g AND w.idx // 16 = r.idx)"
            )
        return ",\n".join(parts)

    code = lambda c: f"coalesce(concat(strlen(CAST({c} AS VARCHAR)), ':', {c}), '-')"
    lower = "CASE WHEN crc % 5 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END"
    head = [code(c) for c in ("doc_id", "source", "lang", "n_chars")]
    return f"""
WITH RECURSIVE bits(i, k, c) AS (SELECT range, 0, range FROM range(256) UNION ALL
  SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM bits WHERE k < 8),
crcs AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
c AS (SELECT d.*, xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
        lambda a, b: xor(a // 256, t[xor(a, b) % 256 + 1])), 4294967295) AS crc FROM documents d, crcs),
h AS (SELECT doc_id, coalesce('1' || source, '0') AS g, sha256(concat({", ".join(head)}, {code("text")})) AS leaf,
        sha256(concat({", ".join(head)}, {code("(" + lower + ")")})) AS presented FROM c),
p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY g) AS n FROM h),
{tree("t", "SELECT g, idx, leaf AS digest, n FROM p")},
s AS (SELECT g AS own, digest, row_number() OVER (ORDER BY g) - 1 AS idx, count(*) OVER () AS n FROM t{levels}),
{tree("u", "SELECT '' AS g, idx, digest, n FROM s")},
{walk("w", "t", "SELECT doc_id, g, idx, leaf, presented AS folded, '' AS proof FROM p")},
{walk("v", "u", f"SELECT w.doc_id, w.leaf, '' AS g, s.idx, s.digest AS subroot, w.folded, w.proof FROM w{levels} w JOIN s ON w.g = s.own")}
SELECT doc_id, leaf, subroot, digest AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = digest AS verified FROM v{levels}, u{levels}
"""


ORACLE_SQL: dict[str, str] = {
    "op11_main_text": r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS h FROM pages),
b AS (SELECT page_id, url, list_transform(string_split_regex(h, '</?(?:p|h1)>'), lambda x: regexp_replace(replace(x, '<br>', ' '), '<[^>]*>', '', 'g')) AS bs FROM a),
c AS (SELECT page_id, url, list_transform(bs, lambda x: trim(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&#x27;', chr(39)), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS bs FROM b),
t AS (SELECT page_id, url, array_to_string(list_filter(bs, lambda x: x <> ''), chr(10) || chr(10)) AS text FROM c)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM t
""",
    "op12_collocations": r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
i AS (SELECT lang, ws, unnest(generate_series(1, len(ws))) AS i FROM w WHERE len(ws) > 0),
g AS (SELECT lang, ws, i, unnest([1, 2, 3, 4]) AS k FROM i),
f AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS n FROM g WHERE i + k - 1 <= len(ws) GROUP BY ALL),
t AS (SELECT lang, sum(n) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS ws FROM f WHERE k >= 2 AND n >= 30),
x AS (SELECT lang, phrase, a, array_to_string(ws[:j], ' ') AS head, array_to_string(ws[j + 1:], ' ') AS tail, j FROM (SELECT *, unnest(generate_series(1, k - 1)) AS j FROM c)),
s AS (SELECT x.lang, x.phrase, x.a, l.n AS l, r.n AS r, j, CAST((2000000::HUGEINT * x.a) // (l.n + r.n) AS BIGINT) AS score
      FROM x JOIN f l ON l.lang = x.lang AND l.phrase = x.head JOIN f r ON r.lang = x.lang AND r.phrase = x.tail),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
u AS (SELECT lang, a, array_to_string(ws[o:o + m - 1], ' ') AS phrase FROM (SELECT *, unnest(generate_series(1, k - m + 1)) AS o FROM (SELECT *, unnest(generate_series(2, k - 1)) AS m FROM c WHERE k >= 3))),
v AS (SELECT lang, phrase, max(a) AS longer FROM u GROUP BY lang, phrase),
q AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
      FROM b LEFT JOIN v ON v.lang = b.lang AND v.phrase = b.phrase WHERE longer IS NULL OR 100 * longer < 80 * a)
SELECT q.lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(t.n AS BIGINT) AS n, score FROM q JOIN t USING (lang) WHERE rank <= 2000
""",
    "op13_merkle_manifest": _merkle_sql(),
    "op5_licenses": _license_sql(),
    "op6_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n FROM pages),
q AS (SELECT page_id, n, h, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY h) ELSE page_id END AS target FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest,
       CASE WHEN target = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN target = page_id THEN NULL ELSE target END AS refers_to FROM q
""",
    "op9_quality_rules": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i
      FROM (SELECT doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d)),
g AS (SELECT doc_id, i, w, lead(w, 1) OVER p AS w2, lead(w, 2) OVER p AS w3 FROM w WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT doc_id, i, w, w3 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, w, w2, w3) > 1 AS rep FROM g),
r AS (SELECT doc_id, w, rep OR coalesce(lag(rep, 1) OVER p, false) OR coalesce(lag(rep, 2) OVER p, false) AS hit
      FROM c WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
ws AS (SELECT doc_id, count(*) AS n_words, sum(length(w)) AS word_chars, count(*) FILTER (hit) AS n_repeat_words,
              count(*) FILTER (regexp_matches(w, '[A-Za-z]|[^\x00-\x7F]')) AS n_alpha FROM r GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
      FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
             coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(n_alpha, 0) AS n_alpha,
             length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS n_letters
      FROM d LEFT JOIN ws USING (doc_id) LEFT JOIN l USING (doc_id)),
b AS (SELECT *, CAST(n_words < 50 AS BIGINT) + 2 * CAST(100 * n_repeat_words > 50 * n_words AS BIGINT)
             + 4 * CAST(10 * n_symbols > n_words AS BIGINT)
             + 8 * CAST(n_words > 0 AND (word_chars < 3 * n_words OR word_chars > 12 * n_words) AS BIGINT)
             + 16 * CAST(2 * n_dup_lines > n_lines AS BIGINT) + 32 * CAST(10 * n_upper > 4 * n_letters AS BIGINT)
             + 64 * CAST(10 * n_alpha < 8 * n_words AS BIGINT) + 128 * CAST(n_words > 100000 AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       fail_bits & 3 <> 0 AS base_failed, fail_bits & 127 = 0 AS kept, CAST(fail_bits AS BIGINT) AS fail_bits FROM b
""",
}


def _ablation_sql() -> str:
    policy = rules.PROSE
    values = ", ".join(f"('{r.name}', {1 << r.bit})" for r in rules.RULES if r.name in policy.rules)
    return f"""
WITH q AS (SELECT fail_bits & {policy.mask} AS p FROM ({ORACLE_SQL["op9_quality_rules"]})), v(rule, bit) AS (VALUES {values})
SELECT '{policy.version}' AS policy, rule, count(*) FILTER (p & bit <> 0) AS rejected, count(*) FILTER (p = bit) AS rejected_alone, count(*) FILTER (p = 0) AS kept, count(*) FILTER (p IN (0, bit)) AS kept_without
FROM q, v GROUP BY rule
"""


ORACLE_SQL["quality_rule_ablations"] = _ablation_sql()
