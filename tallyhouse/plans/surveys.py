"""Survey risk, market benchmark, retrieval and shared-equipment reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse.functions.labels import HAZARD_AREAS
from tallyhouse.functions.text import file_slug, name_slug
from tallyhouse.operators.benchmarks import cost_ratios, flag_deviating, performance_index
from tallyhouse.operators.embedding import BUCKETS, DIM, bucket_words, embed_corpus, fit_embedder
from tallyhouse.operators.features import parse_payload
from tallyhouse.operators.paths import Edge, Node, match_path
from tallyhouse.operators.periods import match_periods
from tallyhouse.operators.scoring import (
    composite_scores,
    losses_by_account,
    rating_column,
    rating_scores,
    segment_weights,
)
from tallyhouse.operators.topk import largest_rows
from tallyhouse.operators.vector_search import nearest, nearest_for_each
from tallyhouse.session import stage

ASSIGNED = ("survey_filename", "policy_id", "account_id", "earned_premium")


def extract_ratings(outputs: DataFrame, payload: str = "payload", areas: Sequence[str] = HAZARD_AREAS) -> DataFrame:
    """Rating columns and survey date from the JSON that a model returned per document.

    A document whose JSON is bad keeps its row, with NULL ratings and ``is_parsed`` false.
    """
    fields = [T.StructField(rating_column(a), T.StringType()) for a in areas]
    schema = T.StructType([*fields, T.StructField("survey_date", T.DateType())])
    return parse_payload(outputs, payload, schema).drop(payload)


def assign_policies(
    surveys: DataFrame,
    policies: DataFrame,
    *,
    prefix: str,
    suffix: str = ".pdf",
    separator: str = " ",
    how: str = "inner",
    closed: str = "both",
    grain: str | None = None,
) -> DataFrame:
    """Surveys with the policies of the account named in the file that cover the survey date."""
    named = surveys.withColumn("_slug", file_slug(F.col("survey_filename"), prefix, suffix))
    terms = policies.select(
        name_slug(F.col("account_name"), separator).alias("_slug"),
        "policy_id",
        "account_id",
        "earned_premium",
        "effective_date",
        "expiration_date",
    )
    matched = match_periods(
        named,
        terms,
        on="_slug",
        date="survey_date",
        start="effective_date",
        end="expiration_date",
        how=how,
        closed=closed,
        grain=grain,
    )
    return matched.drop("_slug")


def portfolio_scores(assigned: DataFrame, claims: DataFrame, **options) -> DataFrame:
    """Loss-weighted composite per assigned survey."""
    weights = segment_weights(losses_by_account(claims))
    return composite_scores(rating_scores(assigned, ASSIGNED), weights, ASSIGNED, **options)


def riskiest_surveys(scores: DataFrame, n: int = 5) -> DataFrame:
    top = scores.select("survey_filename", "policy_id", "account_id", "loss_weighted_composite_score")
    # a file may be assigned to several policies: rows that tie in all of these are alike
    return largest_rows(top, "loss_weighted_composite_score", ["survey_filename", "policy_id", "account_id"], n)


def account_benchmarks(accounts: DataFrame) -> DataFrame:
    """Cost ratio, market mean of the year, index and flag per account record."""
    return flag_deviating(performance_index(cost_ratios(accounts)))


def costliest_accounts(benchmarks: DataFrame, n: int = 5) -> DataFrame:
    top = largest_rows(benchmarks, "performance_index", "record_id", n)
    return top.select(
        "record_id",
        "account_id",
        F.round("individual_cost_ratio", 2).alias("account_cost_ratio"),
        F.round("performance_index", 2).alias("performance_index"),
        "is_deviating",
    )


def search_texts(texts: DataFrame, question: str, k: int = 2, *, key: str, text: str) -> DataFrame:
    """The ``k`` texts nearest to a question, with their distance to three digits."""
    bucketed = stage(bucket_words(texts, key, text, DIM), "buckets")
    embedder = fit_embedder(bucketed, DIM)
    asked = texts.sparkSession.createDataFrame([(0, question)], "_question long, _words string")
    query = stage(embedder.transform(asked, "_question", "_words", "_vector").select("_vector"), "question")

    def nearest_of(rows: DataFrame) -> DataFrame:
        return stage(nearest(embedder.weigh(rows, key, "_vector"), query, k, key=key, vector="_vector"), "found")

    # Texts without any word of the question are at distance 1; no weight is below zero, so that none is further.
    said = query.select("_vector.bucket").first()["bucket"] or []
    found = nearest_of(bucketed.filter(F.arrays_overlap(BUCKETS, F.array(*[F.lit(b) for b in said])))) if said else None
    if found is None or found.filter("distance < 1").count() < k:
        found = nearest_of(bucketed)
    # Only the k keys go back to the texts; as literals they reach the files' statistics.
    keys = [row[key] for row in found.select(key).collect()]
    few = texts.select(key, text).filter(F.col(key).isin(keys) if keys else F.lit(False))
    return (
        few.join(F.broadcast(found), key)
        .select(key, text, F.round("distance", 3).alias("cosine_distance"))
        .orderBy("cosine_distance", key)
    )


def search_texts_for_each(
    texts: DataFrame, questions: DataFrame, k: int = 2, *, key: str, text: str, question_key: str, question: str
) -> DataFrame:
    """The ``k`` nearest texts of every question row, as (question_key, key, distance)."""
    embedder, corpus = embed_corpus(texts, key, text, "_vector")
    asked = embedder.transform(questions, question_key, question, "_vector")
    return nearest_for_each(
        corpus, asked, k, key=key, vector="_vector", query_key=question_key, query_vector="_vector"
    )


def shared_equipment(
    policyholders: DataFrame,
    inspectors: DataFrame,
    machinery: DataFrame,
    inspects: DataFrame,
    operates: DataFrame,
    model_name: str,
) -> DataFrame:
    """Policyholders that operate a machine of the model, with each inspector who visited them."""
    paths = match_path(
        [
            Node("i", inspectors, "inspector_id", ["inspector_name"]),
            Node("p", policyholders, "policyholder_id", ["policyholder_id", "company_name"]),
            Node("m", machinery, "machine_id", ["model_name"], F.col("model_name") == model_name),
        ],
        [Edge(inspects, "inspector_id", "policyholder_id"), Edge(operates, "policyholder_id", "machine_id")],
    )
    return paths.select(
        F.col("p_policyholder_id").alias("policyholder_id"),
        F.col("p_company_name").alias("company_name"),
        F.col("i_inspector_name").alias("inspector_name"),
        F.col("m_model_name").alias("model_name"),
    )
