"""The corpus operators as registered queries over whole tables, and DuckDB SQL where it can express them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import table
from . import decontaminate, linededup, mixing, ppm, secrets, simhash, substrings, tokencount, topk, urlfilter


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_guess of every document."""
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(spans):
        parts = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
        return F.array_join(parts, ",")

    base = F.filter("spans", lambda s: s["kind"] != "guess")
    return found.select(
        F.col("id").alias("doc_id"),
        *(count(k) for k in secrets.KINDS[:3]),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        count("guess"),
    )


#: Share of the tokens that each domain should have: quality and toxicity of the labels table.
MIX_TARGETS = {"q1t0": 0.90, "q1t1": 0.02, "q0t0": 0.07, "q0t1": 0.01}


def label_domain():
    """The domain that a row of the labels table stands for."""
    return F.concat(F.lit("q"), F.col("quality").cast("string"), F.lit("t"), F.col("toxic").cast("string"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, tokens, one posterior for each domain, the rate of every document, and how far off the targets the mix is."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = mixing.mixing_rates(docs, labels, label_domain(), MIX_TARGETS)
    posteriors = [F.col("p")[k].alias(f"p_{d}") for k, d in enumerate(MIX_TARGETS)]
    return found.select(F.col("id").alias("doc_id"), "tokens", *posteriors, "rate", "off")


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: the ten best for every vector whose id is divisible by 100."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


OP3_SQL = """
with ints as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v
  from embeddings
  where embedding is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
), scored as (
  select q.vec_id as query_id, c.vec_id,
    cast(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) as bigint) as score
  from ints q join ints c on q.vec_id % 100 = 0 and c.vec_id is distinct from q.vec_id and len(q.v) = len(c.v)
), ranked as (
  select *, row_number() over (partition by query_id order by score desc, vec_id nulls last) as rank from scored
)
select query_id, cast(rank as int) as rank, vec_id, score from ranked where rank <= 10
"""


def held_out(doc_id):
    """Whether a document stays out of what language identification learns from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits and n_bytes of every document."""
    docs = table(spark, sf_dir, "documents")
    model = ppm.fit(docs.where(~held_out("doc_id")), "lang", "text")
    return ppm.predict(docs, model).select(
        F.col("id").alias("doc_id"),
        held_out("id").alias("held_out"),
        F.col("label").alias("lang_pred"),
        "score",
        "bits",
        F.col("bytes").alias("n_bytes"),
    )


def tokenizer_path() -> str:
    """Where the piece vocabulary lies: TOKENIZER_MODEL, else the installed public one."""
    if path := os.environ.get("TOKENIZER_MODEL"):
        return path
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_pretokens, n_tokens of every document.

    The vocabulary file lists pieces by rank without probabilities, so a piece's is taken to fall as 1 / (rank + 1).
    """
    vocabulary = tokencount.vocabulary_of_model(tokenizer_path())
    return tokencount.token_counts(table(spark, sf_dir, "documents"), vocabulary).withColumnRenamed("id", "doc_id")


URL_RULES = [
    urlfilter.Rule("block", "net", "/"),
    urlfilter.Rule("allow", "example.net", "/en/"),
    urlfilter.Rule("block", "example.com", "/de/"),
    urlfilter.Rule("allow", "org", "/fr/"),
]
#: Site names whose pages make up the list of blocked addresses.
LISTED_SITES = ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule and verdict of every page; the list holds every page of the listed sites."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    host, path = urlfilter.host_of(F.col("url")), urlfilter.path_of(F.col("url"))
    sites = r"(^|\.)(" + "|".join(LISTED_SITES) + r")\."
    listed = pages.where(host.rlike(sites)).select(urlfilter.canonical(host, path).alias("key"))
    return urlfilter.filter_urls(pages, URL_RULES, listed).withColumnRenamed("id", "page_id")


OP6_SQL = r"""
with parsed as (
  select page_id, coalesce(translate(regexp_extract(url, '^(.*?)://([^/?#]*)([^?#]*)', 2, 's'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
    coalesce(regexp_extract(url, '^(.*?)://([^/?#]*)([^?#]*)', 3, 's'), '') as path
  from pages
), keyed as (
  select *, regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '(\.html)?/*$', '') as key,
    case when (host = 'example.net' or ends_with(host, '.example.net')) and starts_with(path, '/en/') then 'example.net/en/'
      when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/de/') then 'example.com/de/'
      when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/fr/') then 'org/fr/'
      when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/') then 'net/' end as rule
  from parsed
), listed as (
  select distinct key from keyed
  where regexp_matches(host, '(^|\.)(adult-x|ads-track|casino-win|cheap-pills|free-bets|spam-farm)\.')
)
select page_id, host, path, rule, case
  when rule in ('example.net/en/', 'org/fr/') then 'allow' when rule is not null then 'block'
  when host <> '' and l.key is not null then 'block' else 'allow' end as verdict
from keyed k left join listed l on l.key = k.key
"""


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, edits, item_words, start_word, end_word of every benchmark passage in the documents."""
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumnsRenamed({"id": "doc_id", "item": "item_id"})


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped and the digest of what is left of every document."""
    found = linededup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", "lines.n_lines", "lines.n_dropped", F.sha2(F.col("lines.kept"), 256).alias("kept_sha256")
    )


OP9_SQL = r"""
with split as (
  select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents
), flat as (
  select doc_id, unnest(lines) as line, unnest(range(len(lines))) as pos from split
), keyed as (
  select doc_id, pos, line,
    translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from flat
), common as (
  select key, max(doc_id) as top from keyed where length(key) >= 20
  group by key having count(distinct doc_id) >= 3
), marked as (
  select k.doc_id, pos, line, c.key is not null and c.top <> k.doc_id as gone
  from keyed k left join common c on k.key = c.key
)
select doc_id, cast(count(*) as bigint) as n_lines, cast(count(*) filter (where gone) as bigint) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from marked group by doc_id
"""

def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed and the digest of the words left of every document."""
    found = substrings.substring_dedup(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), "words.n_words", "words.n_removed", F.sha2("words.kept", 256).alias("kept_sha256")
    )


OP10_SQL = r"""
with split as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents
), flat as (
  select doc_id, words, unnest(range(len(words))) as pos from split
), runs as (
  select doc_id, pos, sha256(array_to_string(words[pos + 1 : pos + 35], ' ')) as seq
  from flat where pos + 35 <= len(words)
), twice as (
  select doc_id, pos from runs where seq in (select seq from runs group by seq having count(*) > 1)
), flagged as (
  select f.doc_id, f.pos, f.words[f.pos + 1] as word, t.pos is not null as starts
  from flat f left join twice t on t.doc_id = f.doc_id and t.pos = f.pos
), covered as (
  select doc_id, pos, word,
    max(starts::int) over (partition by doc_id order by pos rows between 34 preceding and current row) = 1 as gone
  from flagged
), sums as (
  select doc_id, count(*) as n, count(*) filter (where gone) as g,
    string_agg(word, ' ' order by pos) filter (where not gone) as kept
  from covered group by doc_id
)
select d.doc_id, cast(coalesce(n, 0) as bigint) as n_words, cast(coalesce(g, 0) as bigint) as n_removed,
  sha256(coalesce(kept, '')) as kept_sha256
from documents d left join sums s on s.doc_id = d.doc_id
"""

QUERIES = {"op1_secret_scan": op1_secret_scan, "op2_mixing": op2_mixing, "op3_top_k": op3_top_k, "op4_language_id": op4_language_id, "op5_token_counts": op5_token_counts, "op6_url_filter": op6_url_filter, "op7_simhash": op7_simhash, "op8_decontaminate": op8_decontaminate, "op9_line_dedup": op9_line_dedup, "op10_substring_dedup": op10_substring_dedup}

ORACLES: dict[str, str] = {"op3_top_k": OP3_SQL, "op6_url_filter": OP6_SQL, "op9_line_dedup": OP9_SQL, "op10_substring_dedup": OP10_SQL}
