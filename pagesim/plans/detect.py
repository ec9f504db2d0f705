"""The flagship: one verdict per url check, as one plan for tables and micro-batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import (
    ERROR_NO_DOM, FEATURES, MINIMAL_DOM_PENALTY, MINIMAL_DOM_THRESHOLD, ML_GATE, SIGNATURE_SOURCE,
    SKIPPED_MESSAGE, SMALL_DOM_THRESHOLD, UNKNOWN, UNVERIFIED_SOURCE,
)
from ..functions.html import as_dom, html_tokens
from ..functions.urls import resource_signature
from ..functions.verdicts import classify_scores, detection_mode, hybrid_decision, signature_input
from ..operators.corpus import newest_pages
from ..operators.distances import MAX_BROADCAST_ROWS, PrototypeSet
from ..operators.features import page_features
from ..operators.model import PageModel
from ..operators.scores import class_scores
from ..operators.signatures import feed_changes, signature_lookup
from ..session import materialize

SCORES = ["phish_min", "phish_avg", "legit_min", "legit_avg"]


def read_pages(pages: DataFrame, small_dom_threshold: int = SMALL_DOM_THRESHOLD,
               keep_html: bool = False) -> DataFrame:
    """Pages to the bytes to classify. No shuffle; one parse gives both the tags
    and the resources, and only the shorter results go on."""
    read = html_tokens(pages, ["tags", "refs"], keep_html=keep_html)
    read = read.withColumn("dom", as_dom(F.col("tags"))).withColumn(
        "dom_length", F.octet_length("dom").cast("bigint"))
    read = read.withColumns({
        "detection_mode": detection_mode(F.col("dom_length"), small_dom_threshold),
        "_sig": resource_signature(F.col("refs"), F.col("url"))})
    usable = F.col("dom_length") > 0
    return read.withColumns({
        "classified": F.when(usable, signature_input(F.col("detection_mode"), F.col("_sig"), F.col("dom"))),
        "resource_sig_length": F.when(usable & (F.col("dom_length") < small_dom_threshold),
                                      F.octet_length("_sig").cast("bigint")),
    }).drop("tags", "refs", "_sig", "dom")


def judge_pages(read: DataFrame, protos: DataFrame | PrototypeSet, key: str = "url",
                distance: str = "ncd", minimal_threshold: int = MINIMAL_DOM_THRESHOLD,
                penalty: float = MINIMAL_DOM_PENALTY, order_col: str = "prototype_index",
                max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Read pages to distance verdicts; one Arrow pass gives all distances."""
    bounded = protos if isinstance(protos, PrototypeSet) else PrototypeSet.load(
        protos, order_col=order_col, max_rows=max_rows)
    scored = class_scores(read, bounded if bounded is not None else protos, key=key,
                          payload="classified", distance=distance, order_col=order_col, max_rows=max_rows)
    has_prototypes = bounded is None or bool(bounded.rows)
    out = classify_scores(scored, "classified", has_prototypes, minimal_threshold, penalty)
    # pages that failed to parse or hold no tag are errors, whatever their defaults score
    error = F.when(~F.coalesce(F.col("dom_length") > 0, F.lit(False)),
                   F.coalesce(F.concat(F.lit("Error extracting DOM: "), F.col("parse_error")), F.lit(ERROR_NO_DOM)))
    return out.withColumn("error", F.coalesce(error, F.col("score_error"))).drop(
        "classified", "score_error", "parse_error")


def classify_pages(pages: DataFrame, protos: DataFrame | PrototypeSet,
                   small_dom_threshold: int = SMALL_DOM_THRESHOLD, keep_html: bool = False,
                   **options) -> DataFrame:
    """``judge_pages`` of ``read_pages``."""
    return judge_pages(read_pages(pages, small_dom_threshold, keep_html), protos, **options)


ML_STRUCT = "struct<label:string,probability:double,legit_probability:double,confidence:string>"
ANSWER = ["verdict", *SCORES, "dom_size", "dom_length", "resource_sig_length", "detection_mode",
          "minimal_dom_adjustment_applied", "final_decision", "reason", "final_verdict",
          "decision_source", "features", "ml_prediction"]


def _answer(read: DataFrame, protos, cluster_protos, model: PageModel | None, gate: float,
            gate_on: str, **options) -> DataFrame:
    """C1, F1-F25, C9, C2 on read pages: their own columns, ``ANSWER``, ``ncd_confidence`` and
    ``ncd_error``."""
    passed = [c for c in read.columns if c not in (
        "html", "classified", "parse_error", "dom_length", "detection_mode", "resource_sig_length")]
    if cluster_protos is not None:  # by bytes, adaptive execution leaves few tasks after a join, each long to compute
        read = read.repartition(4 * read.sparkSession.sparkContext.defaultParallelism)
    out = judge_pages(read, protos, **options)
    out = out.withColumnsRenamed({"confidence": "ncd_confidence", "error": "ncd_error"})
    if cluster_protos is None and model is None:
        out = out.withColumn("features", F.lit(None).cast("struct<" + ",".join(f"{f}:double" for f in FEATURES) + ">"))
    else:
        out = page_features(out, cluster_protos, key=options.get("key", "url"),
                            distance=options.get("distance", "ncd"), max_rows=options.get("max_rows", MAX_BROADCAST_ROWS))
        out = out.withColumn("features", F.struct(*FEATURES))
    if model is None:
        out = out.withColumns({"final_verdict": F.lit(None).cast("string"), "decision_source": F.lit("ncd"),
                               "ml_prediction": F.lit(None).cast(ML_STRUCT)})
    else:
        out = model.predict(out)
        final, decided = hybrid_decision(F.col("verdict"), F.col("ml_label"), F.col("ml_probability"), gate, gate_on)
        out = out.withColumns({
            "final_verdict": final, "decision_source": decided,
            "ml_prediction": F.struct(
                F.col("ml_label").alias("label"), F.col("ml_probability").alias("probability"),
                F.col("ml_legit_probability").alias("legit_probability"),
                F.col("ml_confidence").alias("confidence"))})
    return out.select(*passed, *ANSWER, "ncd_confidence", "ncd_error")


def detect(checks: DataFrame, pages: DataFrame | None, feed: DataFrame, protos: DataFrame | PrototypeSet,
           cluster_protos: DataFrame | PrototypeSet | None = None, model: PageModel | None = None,
           skip_ncd: bool = False, skip_signature: bool = False, enrich=None,
           detection_id: Column | None = None, detected_at: Column | None = None,
           legacy_unverified: bool = False, gate: float = ML_GATE, gate_on: str = "phish",
           small_dom_threshold: int = SMALL_DOM_THRESHOLD, parse_first: bool = True,
           newest: str | None = None, unique_feed: bool = False, **options) -> DataFrame:
    """A verdict for every row of ``checks(url, ...)``; other columns pass through, whatever their names:
    they travel as one struct, and where an answer has the same name the answer stands.

    The feed decides first and only its misses reach the tokenizer. Of several entries of a url
    the one of lowest id answers.

    With ``pages(url, html)``, urls are looked up, parsed and measured once each, and the raw checks
    meet the finished answers in one join, whose hot urls adaptive execution can split. Pages are
    parsed where they lie and only the short results move; without ``parse_first`` the pages of
    misses are found first, which pays when ``pages`` is bucketed by url. Of several pages of a url
    that of the greatest ``newest`` column counts, without one the greatest by content hash.

    With ``pages=None`` every check carries the ``html`` it was rendered to, as a stream of
    checks does; it is judged where it lies and nothing is shuffled beyond the lookup.

    ``enrich`` is a function applied to similarity answers (see ``enrich_domain``).
    ``legacy_unverified`` (C14) takes a feed with a ``verified`` flag: unverified hits go on to
    similarity and answer ``suspicious``."""
    trusted = feed.filter(F.col("verified") == 1) if legacy_unverified else feed
    passed = [c for c in checks.columns if pages is not None or c != "html"]
    carried_columns, needed = passed, ["url"] if pages is not None else ["url", "html"]
    given = {"_given_id": detection_id, "_given_at": detected_at}
    given = [column.alias(name) for name, column in given.items() if column is not None]
    checks = checks.select(*needed, F.struct(*passed, *given).alias("_check"))
    # distinct first: copies of a hot url are merged before anything is shuffled
    one_by_url = pages is not None and not skip_ncd
    looked = signature_lookup(checks.select("url").distinct() if one_by_url else checks, trusted, skip_signature, unique_feed)
    hit = F.coalesce("in_database", F.lit(False))
    # a caller's column gives way to an answer of the same name
    def passing(answer_names):
        return [F.col(f"_check.`{c}`").alias(c) for c in carried_columns if c not in answer_names]

    if skip_ncd:
        names = ["classification", "source", "confidence", "phish_id", "detail_page", "submitted_at", "message"]
        return looked.select(
            *passing(names), F.when(hit, "phish").otherwise("legit").alias("classification"),
            F.lit(SIGNATURE_SOURCE).alias("source"),
            F.when(hit, "high").otherwise("medium").alias("confidence"),
            "phish_id", "detail_page", "submitted_at",
            F.when(~hit, SKIPPED_MESSAGE).alias("message"))

    wants_features = cluster_protos is not None or model is not None
    judge = dict(protos=protos, cluster_protos=cluster_protos, model=model, gate=gate, gate_on=gate_on, **options)
    if pages is None:
        # a hit's text becomes NULL, which every later step passes over
        carried = looked.withColumn("html", F.when(~hit, F.col("html")))
        joined = _answer(read_pages(carried, small_dom_threshold, wants_features), **judge)
        joined = joined.withColumn("_read", F.lit(True))
        if enrich is not None:
            joined = enrich(joined)
    else:
        misses = looked.where(~hit).select("url")
        landed = pages.select("url", "html", *([newest] if newest else []))
        if parse_first:
            read = read_pages(landed, small_dom_threshold, wants_features).join(misses, "url", "left_semi")
        else:
            read = read_pages(landed.join(misses, "url", "left_semi"), small_dom_threshold, wants_features)
        read = newest_pages(read, [c for c in read.columns if c not in ("url", newest)], newest)
        answers = _answer(read, **judge).withColumn("_read", F.lit(True))
        if enrich is not None:
            answers = enrich(answers)
        # the hash in the key gives the finished answers an exchange of their own, as adaptive
        # execution only splits a join between two exchanges
        finished = looked.join(answers, "url", "left").withColumn("_hash", F.xxhash64("url"))
        joined = checks.withColumn("_hash", F.xxhash64("url")).join(finished, ["_hash", "url"], "left").drop("_hash")
    known = {*checks.columns, *looked.columns, "html", *ANSWER, "ncd_confidence", "ncd_error", "_read"}
    extra = [c for c in joined.columns if c not in known]

    error = F.when(~hit, F.coalesce(F.col("ncd_error"), F.when(F.col("_read").isNull(), ERROR_NO_DOM)))
    joined = joined.withColumn("error", error)
    bad = F.col("error").isNotNull()
    similar = ~hit & ~bad

    def only_similar(column):
        return F.when(similar, F.col(column)).alias(column)

    identity = F.uuid() if detection_id is None else F.col("_check._given_id")
    at = F.current_timestamp() if detected_at is None else F.col("_check._given_at")
    answers_to = [
        F.when(hit, "phish").when(bad, UNKNOWN).otherwise(F.coalesce("final_verdict", "verdict")).alias("classification"),
        F.when(hit, SIGNATURE_SOURCE).when(bad, "error").otherwise(F.col("decision_source")).alias("source"),
        F.when(hit, "high").when(bad, "low").otherwise(F.col("ncd_confidence")).alias("confidence"),
        "phish_id", "detail_page", "submitted_at", F.lit(None).cast("string").alias("message"), "error",
        only_similar("verdict"),
        F.when(similar, F.struct(*SCORES)).alias("prototype_scores"),
        *[only_similar(c) for c in ["dom_size", "dom_length", "resource_sig_length", "detection_mode",
                                    "minimal_dom_adjustment_applied", "final_decision", "reason",
                                    "features", "ml_prediction", *extra]],
        F.when(similar, identity.cast("string")).alias("detection_id"),
        at.alias("detected_at"),
    ]
    names = {"classification", "source", "confidence", "phish_id", "detail_page", "submitted_at", "message", "error", "verdict",
             "prototype_scores", "dom_size", "dom_length", "resource_sig_length", "detection_mode", "minimal_dom_adjustment_applied",
             "final_decision", "reason", "features", "ml_prediction", "detection_id", "detected_at", *extra}
    out = joined.select(*passing(names), *answers_to)
    return _mark_unverified(out, feed) if legacy_unverified else out


def redetect(checks: DataFrame, before: DataFrame, old_feed: DataFrame, new_feed: DataFrame, detect_with,
             key: str = "event_id") -> tuple[DataFrame, DataFrame]:
    """(answers, judged): the detections under a new version of the feed, from those under the old one.

    Only checks of urls whose entry was added, removed or changed are detected again, by
    ``detect_with(checks, feed)``; ``judged`` are these answers. All others keep theirs from ``before``, which has a
    row for each check by ``key``."""
    urls = materialize(feed_changes(old_feed, new_feed).select("url"), "changed-urls")
    judged = materialize(detect_with(checks.join(urls, "url", "left_semi").select(*checks.columns), new_feed), "redetected")
    kept = before.join(urls, "url", "left_anti").select(*before.columns)
    return kept.unionByName(judged.select(*before.columns)), judged


def _mark_unverified(answers: DataFrame, feed: DataFrame) -> DataFrame:
    """C14: the similarity answer of an unverified feed row is kept, nested, under a
    ``suspicious`` one."""
    rows = feed.filter(F.col("verified") == 0).select("url", F.col("phish_id").alias("_unverified_id"))
    joined = answers.join(rows.groupBy("url").agg(F.max("_unverified_id").alias("_unverified_id")), "url", "left")
    flagged = F.col("_unverified_id").isNotNull() & F.col("phish_id").isNull()
    nested = F.struct("classification", "source", "confidence", "prototype_scores")
    return joined.withColumn("similarity", F.when(flagged, nested)).withColumns({
        "classification": F.when(flagged, "suspicious").otherwise(F.col("classification")),
        "source": F.when(flagged, UNVERIFIED_SOURCE).otherwise(F.col("source")),
        "confidence": F.when(flagged, "medium").otherwise(F.col("confidence")),
    }).drop("_unverified_id")
