"""Queries over stored postings: keyword search by minimal covers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from feedloom.operators import keywords
from feedloom.plans.fixtures import table
from feedloom.plans.registry import query
from feedloom.storage import shared_folder

#: How many of its rarest words that another text has, too, a document asks for.
ASKED = 2


def questions(stock: DataFrame) -> DataFrame:
    """(question_id, text): what the documents of ids divisible by 50 ask for: the ASKED rarest of their words that another document has, too."""
    counts = stock.groupBy("term").agg(F.count("*").alias("texts")).where("texts > 1")
    mine = stock.where("record_id % 50 = 0").select("term", F.col("record_id").alias("question_id")).join(counts, "term")
    order = Window.partitionBy("question_id").orderBy("texts", "term")
    few = mine.withColumn("n", F.row_number().over(order)).where(F.col("n") <= ASKED)
    return few.groupBy("question_id").agg(F.array_join(F.sort_array(F.collect_list("term")), " ").alias("text"))


@query(
    rf"""with w as (select doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') as w from documents where text is not null),
    spot as (select doc_id, unnest(w) as term, unnest(range(len(w))) as at from w),
    counts as (select term, count(distinct doc_id) as texts from spot group by term having count(distinct doc_id) > 1),
    asked as (select q.doc_id as question_id, q.term from (select distinct doc_id, term from spot where doc_id % 50 = 0) q join counts using (term)
      qualify row_number() over (partition by q.doc_id order by texts, q.term) <= {ASKED}),
    sizes as (select question_id, count(*) as size from asked group by question_id),
    hit as (select a.question_id, s.doc_id, s.term, s.at from asked a join spot s using (term)),
    seen as (select h.question_id, h.doc_id, h.at as upto, p.term, max(p.at) as last from hit h join hit p on p.question_id = h.question_id and p.doc_id = h.doc_id and p.at <= h.at group by all),
    ends as (select question_id, doc_id, upto, min(last) as low from seen join sizes using (question_id) group by question_id, doc_id, upto, size having count(*) = size),
    covers as (select question_id, doc_id, low, min(upto) as upto from ends group by all),
    scored as (select question_id, doc_id as record_id, sum({keywords.SCALE} // (upto - low + 1))::double / {keywords.SCALE} as score from covers group by all)
    select question_id, row_number() over (partition by question_id order by score desc, record_id) as place, record_id, round(score, 6) as score from scored
    qualify row_number() over (partition by question_id order by score desc, record_id) <= {keywords.MOST}"""
)
def vc09_keyword_search(spark, sf_dir):
    """Every fiftieth document's question against all documents, whose postings are stored in two steps: those of odd ids are added to the others."""
    path = f"{shared_folder(spark)}/postings-{uuid.uuid4().hex}"
    records = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("record_id"), "text")
    for part in (records.where("record_id % 2 = 0"), records.where("record_id % 2 <> 0")):
        keywords.write(part, path)
    stock = keywords.read(spark, path)
    return keywords.search(stock, questions(stock)).withColumn("score", F.round("score", 6))
