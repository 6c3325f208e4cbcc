"""One query for each corpus operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return put


def multilingual_vocabulary(spark):
    import public_tokenizers

    from .bpe import Vocabulary

    return Vocabulary(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def token_digests(spark, docs):
    """doc_id, number of tokens, and digests of the ids and of the decoded bytes."""
    from . import bpe

    out = bpe.encode(docs.select("doc_id", "text"), multilingual_vocabulary(spark), with_bytes=True)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


@query("op2_byte_bpe")
def op2(spark, sf_dir):
    return token_digests(spark, table(spark, sf_dir, "documents"))


@query(
    "op10_substring_dedup",
    r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (
  SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS h
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w)),
rep AS (
  SELECT doc_id, i FROM win WHERE h IN (SELECT h FROM win GROUP BY h HAVING count(*) > 1)),
cov AS (
  SELECT DISTINCT doc_id, i + j AS p FROM rep, (SELECT unnest(range(0, 35)) AS j)),
word AS (
  SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (
  SELECT word.doc_id, string_agg(word, ' ' ORDER BY word.p) AS kept, count(*) AS n
  FROM word LEFT JOIN cov ON word.doc_id = cov.doc_id AND word.p = cov.p
  WHERE cov.p IS NULL GROUP BY word.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id""",
)
def op10(spark, sf_dir):
    from . import substrings

    out = substrings.remove_repeated(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op5_simhash")
def op5(spark, sf_dir):
    from . import simhash

    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


@query("op1_decontamination")
def op1(spark, sf_dir):
    """Documents and the benchmark items that they cover."""
    from . import decontaminate

    out = decontaminate.with_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    out = out.select("doc_id", F.explode("leaks").alias("leak"))
    return out.select("doc_id", "leak.item_id", F.round("leak.coverage", 6).alias("coverage"), "leak.tiles")


@query("op9_language_id")
def op9(spark, sf_dir):
    from . import langid

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    network = langid.train(langid.sample(docs))
    out = langid.predict(docs.select("doc_id", "text"), network)
    return out.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def span_text(spans):
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def span_digests(df, kinds):
    """doc_id, a count of each kind, the digest of the base spans, and all spans."""
    # a lambda's second parameter would be the index
    of = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [of(k) for k in kinds]
    return df.select("doc_id", *counts, F.sha2(span_text(F.col("base")), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))


@query("op8_pii")
def op8(spark, sf_dir):
    from . import pii

    return span_digests(pii.with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False), pii.KINDS)


#: Rules of the URL filter, and sites that are listed: names under each of the example domains.
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
LISTED_SITES = ["adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm"]
LISTED_DOMAINS = ["example.com", "example.net", "example.org"]


@query(
    "op6_url_filter",
    r"""
WITH u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
h AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/') THEN 'org/' END AS rule FROM h)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block'
  WHEN rule IS NOT NULL THEN 'allow'
  WHEN regexp_matches(host, '(^|\.)(adult-x|ads-track|casino-win|cheap-pills|free-bets|spam-farm)\.example\.(com|net|org)$') THEN 'block'
  ELSE 'allow' END AS verdict FROM r""",
)
def op6(spark, sf_dir):
    from . import urls

    listed = spark.createDataFrame([(f"{s}.{d}/",) for s in LISTED_SITES for d in LISTED_DOMAINS], "form string")
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), listed, URL_RULES).drop("url")


@query("op7_html_text")
def op7(spark, sf_dir):
    from . import html

    out = html.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("html")
    return out.withColumn("n_chars", F.length("text").cast("long"))


@query("op3_secrets")
def op3(spark, sf_dir):
    from . import secrets

    return span_digests(secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text")), secrets.KINDS)


@query("op4_fingerprints")
def op4(spark, sf_dir):
    from . import fingerprints as fp

    out = fp.edited(table(spark, sf_dir, "documents"))
    a, b, c = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return out.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fp.as_text(a).alias("fingerprint"),
        fp.as_text(b).alias("edited_fingerprint"),
        fp.likeness(a, b).alias("near_edited"),
        fp.likeness(a, c).alias("near_next"),
        fp.containment(a, b).alias("within_edited"),
        fp.containment(a, c).alias("within_next"),
    )


@query(
    "op13_fill_in_middle",
    r"""
WITH u AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS us,
    sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents),
h AS (
  SELECT doc_id, t, us, len(us) AS n, ('0x' || s[1:8])::BIGINT AS h1, ('0x' || s[9:16])::BIGINT AS h2,
    ('0x' || s[17:24])::BIGINT AS h3, ('0x' || s[25:32])::BIGINT AS h4 FROM u),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
      WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (
  SELECT *, array_to_string(us[1:a], '') AS prefix, array_to_string(us[a + 1:b], '') AS middle, array_to_string(us[b + 1:], '') AS suffix FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p""",
)
def op13(spark, sf_dir):
    from . import infill

    out = infill.transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digests = [F.sha2("output", 256).alias("output_sha256"), F.sha2(infill.restored("output", "form"), 256).alias("restored_sha256")]
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


@query(
    "op11_suffix_dedup",
    r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
blocks AS (
  SELECT r, a, substr(x, 2 * a + 1, 2 * (1024 + 399)) AS y
  FROM (SELECT r, x, unnest(range(0, length(x) // 2 - 399, 1024)) AS a FROM d)),
win AS (
  SELECT r, a + j AS i, md5(substr(y, 2 * j + 1, 800)) AS h
  FROM (SELECT r, a, y, unnest(range(0, least(1024, length(y) // 2 - 399))) AS j FROM blocks)),
rep AS (
  SELECT r, i FROM win WHERE h IN (SELECT h FROM win GROUP BY h HAVING count(*) > 1)),
runs AS (
  SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 400 THEN 0 ELSE 1 END AS new FROM rep),
spans AS (
  SELECT r, min(i) AS a, max(i) + 400 AS b
  FROM (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS k FROM runs) GROUP BY r, k),
pieces AS (
  SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS f FROM spans
  UNION ALL
  SELECT d.r, length(x) // 2, length(x) // 2, coalesce(max(b), 0) FROM d LEFT JOIN spans ON d.r = spans.r GROUP BY d.r, x),
kept AS (
  SELECT d.r, any_value(doc_id) AS doc_id, any_value(length(x) // 2) AS n, sum(b - a) AS gone, count(*) - 1 AS spans,
    string_agg(substr(x, 2 * f + 1, 2 * (a - f)), '' ORDER BY a, b) AS k
  FROM d JOIN pieces ON d.r = pieces.r GROUP BY d.r)
SELECT doc_id, n::BIGINT AS n_bytes, gone::BIGINT AS n_removed, spans::BIGINT AS n_spans, sha256(unhex(k)) AS kept_sha256 FROM kept""",
)
def op11(spark, sf_dir):
    from . import suffixes

    out = suffixes.remove_repeated(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query(
    "op12_prefix_trie",
    r"""
WITH t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
    coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
h AS (
  SELECT c, c - c % 100 AS b, xor(list_reduce(list_prepend(4294967295::BIGINT,
      list_transform(string_split(c::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
    lambda a, s: list_reduce(list_prepend(xor(a, s), range(8)), lambda z, j: xor(z >> 1, 3988292384 * (z & 1)))), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT c FROM t)),
m AS (
  SELECT h.c, b, h, least(h, (SELECT count(*) FROM t WHERE t.c = h.b)) AS m FROM h),
rows AS (
  SELECT t.c, i - h + m AS d, r, x FROM t JOIN m ON t.c = m.c WHERE i > h
  UNION ALL
  SELECT m.c, i, r, x FROM m JOIN t ON t.c = m.b WHERE i <= h),
p AS (
  SELECT c, d, d || ':' || md5(string_agg(md5(r) || md5(x), '') OVER (PARTITION BY c ORDER BY d)) AS k, length(x) AS chars FROM rows
  UNION ALL
  SELECT c, 0, 'root', 0 FROM m),
q AS (
  SELECT *, lag(k) OVER (PARTITION BY c ORDER BY d) AS pk, d = max(d) OVER (PARTITION BY c) AS ends FROM p),
node AS (
  SELECT k, any_value(d) AS d, any_value(pk) AS pk, any_value(chars) AS chars, min(c) AS conv, count(*) AS n,
    string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ends) AS ids FROM q GROUP BY k),
kids AS (
  SELECT pk, count(*) AS n FROM node WHERE pk IS NOT NULL GROUP BY pk),
sub AS (
  SELECT q.k, count(*) FILTER (WHERE kids.pk IS NULL) AS leaves, sum((node.n - 1) * node.chars) AS saved
  FROM node JOIN q ON q.c = node.conv AND q.d <= node.d LEFT JOIN kids ON kids.pk = node.k GROUP BY q.k)
SELECT node.conv AS conv_id, node.d::BIGINT AS depth, parent.conv AS parent_conv_id, node.n::BIGINT AS n_convs,
  coalesce(kids.n, 0)::BIGINT AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens,
  sha256(coalesce(node.ids, '')) AS ends_sha256
FROM node JOIN sub ON sub.k = node.k LEFT JOIN kids ON kids.pk = node.k LEFT JOIN node AS parent ON parent.k = node.pk""",
)
def op12(spark, sf_dir):
    from . import tries

    out = tries.prefix_trie(table(spark, sf_dir, "conversations"))
    return out.drop("preorder", "subtree_end")
