"""The corpus operators as registered queries, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm import bpe, divergence, embedding_dedup, fingerprints, lexical_search, mixing, pii, secrets, simhash, substrings, token_counts, toxicity, vector_search
from feedloom.llm.shared import read


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document under the unigram model. Null texts have none; repeated rows stay; an empty table gives no rows."""
    return token_counts.counted(read(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.tiktoken"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness and that of the next document. Null texts count as empty; a null id is the lowest; a table of one document is followed by itself."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    df = fingerprints.with_next(docs, lambda d: fingerprints.with_signature(d, "text", "signature"))
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    df = df.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next.text", F.lit(1), cut)))
    df = fingerprints.with_signature(df, "edited", "edited_signature")
    own, edited = F.col("signature"), F.col("edited_signature")
    return df.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprints.written(own).alias("fingerprint"),
        fingerprints.written(edited).alias("edited_fingerprint"),
        fingerprints.likeness(own, edited).alias("near_edited"),
        fingerprints.likeness(own, F.col("next.signature")).alias("near_next"),
    )


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at a cosine of 0.9. Unusable vectors link with nothing; a null id has a null component; repeated rows are copies."""
    return embedding_dedup.near_duplicates(read(spark, sf_dir, "embeddings"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document. Null texts count as empty; repeated rows stay."""
    return pii.scan(read(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity of every document, by a model fitted on the labelled ones. Null texts are graded as texts without features; without labels of both kinds all is clean."""
    docs = read(spark, sf_dir, "documents")
    return toxicity.graded(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document. Null texts count as empty; repeated rows stay."""
    df = secrets.found(read(spark, sf_dir, "documents"))
    n = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    counts = [n(k).alias(f"n_{name}") for k, name in enumerate(secrets.KINDS[:3])]
    return df.select("doc_id", *counts, F.sha2(secrets.written(F.col("base")), 256).alias("base_sha256"), secrets.written(F.col("spans")).alias("spans"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document at 2 bits. Texts without words have fingerprint zero; a null id has a null component."""
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, removed words and a hash of the kept ones of every document. Null texts have no words; each row is a document of its own."""
    return substrings.removed(read(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its slot and position in the mix of sources, and the length and hash of its text, which is mixed with it. Null texts have neither."""
    mixed = mixing.mixed(read(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "source", "slot", "position", F.length("text").alias("n_chars"), F.xxhash64("text").alias("text_hash"))


def tokenizer(name: str) -> str:
    """Place of a public tokenizer's file."""
    return public_tokenizers.path(name)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and hash of every document's token ids, and a hash of the text that they decode to. Null texts count as empty."""
    return bpe.digests(read(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of every source from the others of its language, and the terms that tell it from its language. Null texts, languages and sources count as ''."""
    return divergence.audited(read(spark, sf_dir, "documents"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents for every benchmark item. Null texts hold no term; a null doc_id comes first among equals; repeated rows are documents of their own."""
    return lexical_search.searched(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 vectors of highest inner product for every vector whose id is divisible by 20. Unusable vectors take no part; a null id comes last among equals."""
    return vector_search.searched(read(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_token_counts": op1_token_counts, "op2_fingerprints": op2_fingerprints, "op3_embedding_dedup": op3_embedding_dedup, "op4_pii": op4_pii, "op5_toxicity": op5_toxicity, "op6_secrets": op6_secrets, "op7_simhash": op7_simhash, "op8_substrings": op8_substrings, "op9_mixing": op9_mixing, "op10_bpe": op10_bpe, "op11_divergence": op11_divergence, "op12_lexical_search": op12_lexical_search, "op13_vector_search": op13_vector_search}


#: All pairs of vectors, and the least id that links reach from each.
EMBEDDING_SQL = """with recursive v as (select vec_id, embedding::double[] as x from embeddings),
e as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and list_cosine_similarity(a.x, b.x) >= 0.9),
reached(id, root) as (select vec_id, vec_id from v union select e.b, r.root from reached r join e on e.a = r.id)
select vec_id, (select count(*) from e where e.a = v.vec_id) as n_links, c.root as component_id, c.root = vec_id as kept
from v join (select id, min(root) as root from reached group by id) c on c.id = v.vec_id"""

#: Every window of 20 words with its places; ids are unique in the tables that this runs on.
SUBSTRING_SQL = r"""with d as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as words from documents),
windows as (select doc_id, i, array_to_string(words[i:i + 19], ' ') as w from d, unnest(range(1, len(words) - 18)) as u(i)),
late as (select doc_id, i from (select doc_id, i, row_number() over (partition by w order by doc_id, i) as place from windows) where place > 1),
gone as (select doc_id, list(distinct i + k) as spots from late, range(0, 20) as r(k) group by doc_id)
select doc_id, len(words) as n_words, coalesce(len(spots), 0) as n_removed, sha256(array_to_string(case when spots is null then words else list_filter(words, lambda w, n: not list_contains(spots, n)) end, ' ')) as kept_sha256 from d left join gone using (doc_id)"""


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Every kept term in every group, with zero counts written out.
DIVERGENCE_SQL = rf"""with d as (select row_number() over () as id, coalesce(text, '') as text, coalesce(lang, '') as lang, coalesce(source, '') as source from documents),
w as (select id, lang, source, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
kept as (select lang, term from w group by lang, term having count(distinct id) >= 10),
sizes as (select lang, count(*) as v from kept group by lang),
counts as (select lang, source, term, count(*) as n from w join kept using (lang, term) group by all),
groups as (select distinct lang, source from d),
whole as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n, s.v from groups g join kept k using (lang) join sizes s using (lang) left join counts c on c.lang = g.lang and c.source = g.source and c.term = k.term),
p as (select lang, source, term, n, 1 + (1000000000 * (n + 2)::hugeint) // (sum(n) over (partition by lang, source) + 2 * v) as p from whole),
langs as (select lang, term, 1 + (1000000000 * (sum(n) + 2)::hugeint) // (sum(sum(n)) over (partition by lang) + 2 * max(v)) as q from whole group by lang, term),
pairs as (select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
all_pairs as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(x.value, 0) as value from groups a join groups b on a.lang = b.lang and a.source <> b.source left join pairs x on x.lang = a.lang and x.source = a.source and x.item = b.source),
terms as (select p.lang, p.source, 'term' as part, p.term as item, ((p.p - q) * (p.p - q)) // (p.p + q) as value from p join langs using (lang, term) where p.n > 0 and p.p > q)
select lang, source, part, item, value::bigint as value, rank::int as rank from (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from (select * from all_pairs union all select * from terms)) where part = 'pair' or rank <= 10"""

#: Every document's score for every item.
LEXICAL_SQL = rf"""with d as (select row_number() over () as id, doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as words from documents),
lengths as (select id, doc_id, len(words) as n from d where len(words) > 0),
whole as (select count(*) as docs, sum(n)::bigint as tokens from lengths),
tf as (select id, term, count(*) as tf from (select id, unnest(words) as term from d) group by all),
weights as (select term, floor(1000 * ln((2 * max(docs) + 2) / (2 * count(*) + 1)))::bigint as w from tf, whole group by term),
items as (select item_id, term, count(*) as times from (select item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark) group by all),
scores as (select item_id, id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // tokens)))) as score from items join tf using (term) join weights using (term) join lengths using (id), whole group by all)
select item_id, rank::int as rank, doc_id, score::bigint as score from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scores where score > 0) where rank <= 20"""

#: Every query against every other row.
VECTOR_SQL = """with v as (select row_number() over () as id, vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as x from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)
select query_id, rank::int as rank, vec_id, score from (select *, row_number() over (partition by q order by score desc, vec_id) as rank from (select a.id as q, a.vec_id as query_id, b.vec_id, list_dot_product(a.x, b.x)::bigint as score from v a join v b on a.vec_id % 20 = 0 and a.id <> b.id)) where rank <= 20"""


def oracle_sql() -> dict[str, str]:
    return {"op3_embedding_dedup": EMBEDDING_SQL, "op8_substrings": SUBSTRING_SQL, "op11_divergence": DIVERGENCE_SQL, "op12_lexical_search": LEXICAL_SQL, "op13_vector_search": VECTOR_SQL}
