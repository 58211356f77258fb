"""Cohort tables: per stay, per person, collapsed, and first visits."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.functions import scalars as S
from stayline.functions.hashing import hash32
from stayline.functions.ordering import HOT_ROWS
from stayline.operators import aggregates as A
from stayline.operators import codes as C
from stayline.operators import filters as X
from stayline.operators import measures as M
from stayline.operators.joins import dealt, keep_members, left_chain
from stayline.operators.limits import cap_entities
from stayline.operators.sampling import hash_bucket_sample, in_bucket
from stayline.plans.labels import label_any_unplanned, label_lead
from stayline.session import cut_lineage
from stayline.sources import reference as R
from stayline.sources.tables import write_bucketed

ELIX_FLAGS = C.flag_names([g for g, _ in R.ELIXHAUSER_WEIGHTS], "ex_")
CHARLSON_WEIGHTS = {g: w for g, w, _, _ in R.CHARLSON}
VITALS = [
    "hr_mean", "rr_mean", "spo2_mean", "temp_c_mean", "map_mean_pref", "map_ni_mean", "sbp_ni_mean", "dbp_ni_mean",
]

STAY_IDS = 2_000_000  # ids alone that are broadcast


def cohort_admission(
    tables: Mapping[str, DataFrame], *, sample_mod: int = 1000, sample_bucket: int | None = None, limit: int | None = None,
    charlson: DataFrame | None = None, elixhauser: DataFrame | None = None, threshold: float = HOT_ROWS,
    buckets: int | None = None,
) -> DataFrame:
    """Stays with label, merged note, code counts and scores, labs, and one row per unit stay with vitals.

    `tables`: admissions, patients, notes, diagnoses, procedures, labs, lab_items, unit_stays, vitals,
    vital_items. The sample is applied first, to every table that has the stay id, so the feature
    aggregates never see rows outside it; the label alone is computed on the full table. Without `sample_bucket`
    there is no sample, without `limit` no cut; the cut takes rows by hash, so both grains keep their shares. The stays of the
    rows that a cut keeps, or else those with a note, are found by their ids alone; no other stay's features or texts are
    built, unless there are more than STAY_IDS such stays. With `buckets`
    every feature table is written bucketed by the stay, and the joins need no shuffle.
    """
    spark = tables["admissions"].sparkSession
    charlson = charlson if charlson is not None else R.charlson_table(spark)
    elixhauser = elixhauser if elixhauser is not None else R.elixhauser_table(spark)

    chosen: DataFrame | None = None

    def sampled(name: str) -> DataFrame:
        df = tables[name] if sample_bucket is None else hash_bucket_sample(tables[name], "hadm_id", sample_mod, sample_bucket)
        return df if chosen is None else df.join(chosen, "hadm_id", "left_semi")

    labelled = label_lead(tables["admissions"], threshold=threshold)
    base = X.exclude_event_window(
        X.valid_stays(labelled if sample_bucket is None else labelled.filter(in_bucket("hadm_id", sample_mod, sample_bucket))),
        tables["patients"],
    ).drop("deathtime")
    if limit is not None:
        chosen = _stays_within(base, sampled("notes"), sampled("unit_stays"), limit)
    else:
        chosen = _noted_stays(base, sampled("notes"))
    if chosen is not None:
        base = base.join(chosen, "hadm_id", "left_semi")
    notes = A.merge_texts(
        sampled("notes").withColumn("_time", F.coalesce("charttime", "storetime")), ["subject_id", "hadm_id"],
        order=["_time", "note_id"], split=True,
    ).withColumnRenamed("text", "note_text")

    dx = sampled("diagnoses")
    scores = C.score_systems(dx, [
        C.CodeSystem(charlson, R.CHARLSON_FLAGS, CHARLSON_WEIGHTS, "cci_score", distinct_weights=True),
        C.CodeSystem(elixhauser, ELIX_FLAGS, dict(R.ELIXHAUSER_WEIGHTS), "elix_vw_score"),
    ])
    labs = M.measure_pivot(M.lookup_join(
        sampled("labs").filter("hadm_id is not null"), tables["lab_items"], M.all_labels(R.LAB_LABELS)
    ))
    stays = sampled("unit_stays").select(
        "hadm_id", F.col("stay_id").alias("icu_stay_id"), F.col("intime").alias("icu_intime"),
        F.col("outtime").alias("icu_outtime"),
    )
    stay_counts = stays.groupBy("hadm_id").agg(F.count(F.lit(1)).alias("icu_stay_count"))
    units = stays.select(F.col("icu_stay_id").alias("stay_id"))
    items = tables["vital_items"].filter("linksto = 'chartevents'")
    if chosen is not None:  # few stays: their rows are found first
        rows = tables["vitals"].filter("valuenum is not null")
        chart = M.lookup_join(keep_members(rows, units, "stay_id"), items, M.all_labels(R.VITAL_LABELS))
    else:
        chart = keep_members(M.lookup_join(tables["vitals"], items, M.all_labels(R.VITAL_LABELS)), units, "stay_id")
        chart = dealt(chart, "stay_id", tables["vitals"].count())
    vitals = M.mean_pivot(chart).withColumnRenamed("stay_id", "icu_stay_id")

    features = [
        base.join(notes, ["subject_id", "hadm_id"]), A.code_counts(dx), A.code_counts(sampled("procedures"), prefix="proc"),
        scores, labs, stay_counts, stays.join(vitals, "icu_stay_id", "left"),
    ]
    if buckets is not None:
        features = [write_bucketed(f, "hadm_id", buckets) for f in features]
    wide = left_chain(features[0], *[(f, "hadm_id") for f in features[1:]])
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("cci_score", "elix_vw_score", "icu_stay_count")}
    out = X.row_grain(wide.withColumns(zero), "icu_stay_id").withColumn(
        "map_mean_pref", F.coalesce("map_art_mean", "map_ni_mean")
    )
    return out.orderBy(hash32("grain_id"), "grain_id").limit(limit) if limit is not None else out


def _noted_stays(base: DataFrame, notes: DataFrame) -> DataFrame | None:
    """(hadm_id) of the stays that have a note, to be broadcast; None if there are more than STAY_IDS."""
    noted = X.nonblank_text(notes).select("subject_id", "hadm_id").distinct()
    ids = cut_lineage(base.select("subject_id", "hadm_id").join(noted, ["subject_id", "hadm_id"]).select("hadm_id").distinct())
    return F.broadcast(ids) if ids.limit(STAY_IDS + 1).count() <= STAY_IDS else None


def _stays_within(base: DataFrame, notes: DataFrame, unit_stays: DataFrame, limit: int) -> DataFrame:
    """(hadm_id) of the stays of the first `limit` rows of the cohort in the order of its cut, and of rows equal to the last."""
    noted = X.nonblank_text(notes).select("subject_id", "hadm_id")
    stays = unit_stays.select("hadm_id", F.col("stay_id").alias("icu_stay_id"))
    keys = base.select("subject_id", "hadm_id").join(noted.distinct(), ["subject_id", "hadm_id"]).join(stays, "hadm_id", "left")
    grains = cut_lineage(X.row_grain(keys, "icu_stay_id").select("hadm_id", F.struct(hash32("grain_id"), "grain_id").alias("_at")))
    last = grains.select("_at").orderBy("_at").limit(limit).agg(F.max("_at").alias("_last"))  # one row
    ids = grains.join(F.broadcast(last), F.col("_at") <= F.col("_last")).select("hadm_id").distinct()
    return C.small_table(cut_lineage(ids))


def cohort_patient(
    admissions: DataFrame, diagnoses: DataFrame, procedures: DataFrame, vitals: DataFrame, *,
    patients: DataFrame | None = None, notes: DataFrame | None = None, sample_mod: int = 1000,
    sample_bucket: int | None = None, target_n: int | None = None, threshold: float = HOT_ROWS,
) -> DataFrame:
    """One row per sampled person: the earliest eligible stay with code counts, mean rate, label, hours.

    With `patients` the death window is applied, with `notes` a non-blank note is required (the written
    rules); without them only the template's own conditions hold. Persons are sampled and capped only where
    `sample_bucket` and `target_n` say so. Persons are fixed before any feature join.
    """
    eligible = X.valid_stays(admissions)
    if patients is not None:
        eligible = X.exclude_event_window(eligible, patients)
    if notes is not None:
        eligible = eligible.join(X.nonblank_text(notes).select("hadm_id"), "hadm_id", "left_semi")
    earliest = A.argmin_row(
        eligible.select("subject_id", "hadm_id", "admittime", "dischtime", "admission_type"),
        "subject_id", ["admittime", "hadm_id"],
    )
    people = earliest if sample_bucket is None else hash_bucket_sample(earliest, "subject_id", sample_mod, sample_bucket)
    people = people.select("subject_id") if target_n is None else cap_entities(people, "subject_id", target_n)
    if target_n is not None and target_n <= C.MAX_BROADCAST_ROWS:  # the limit itself bounds the broadcast
        people = F.broadcast(people)
    index = earliest.join(people, "subject_id", "left_semi")
    labelled = label_any_unplanned(index, admissions.join(people, "subject_id", "left_semi"), threshold=threshold)
    ids = index.select("hadm_id")
    if target_n is not None and target_n <= C.MAX_BROADCAST_ROWS:
        ids = F.broadcast(ids)
    some = sample_bucket is not None or target_n is not None

    def kept(df: DataFrame, *columns) -> DataFrame:
        rows = df.select("hadm_id", *columns)
        return rows.join(ids, "hadm_id", "left_semi") if some else rows  # of all persons, rows are added up before they meet stays

    one = F.lit(1)
    facts = [kept(diagnoses, one.alias("_dx")), kept(procedures, one.alias("_px")), kept(vitals, "heart_rate")]
    counts = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), facts).groupBy("hadm_id").agg(
        F.sum("_dx").alias("n_dx_codes"), F.sum("_px").alias("n_px_codes"), F.avg("heart_rate").alias("icu_mean_hr")
    )
    return left_chain(
        labelled.withColumn("los_hours", S.whole_hours("admittime", "dischtime")), (counts, "hadm_id")
    ).select(
        "subject_id", "hadm_id", "los_hours", "n_dx_codes", "n_px_codes", "icu_mean_hr", "readmit_30d_unplanned"
    )


def add_durations(df: DataFrame) -> DataFrame:
    """Stay and unit hours; negative durations (bad clocks) become NULL."""
    return df.withColumns({
        "length_of_icu_stay_hours": S.negative_to_null(S.hours_between("icu_intime", "icu_outtime")),
        "admit_to_disch_hours": S.negative_to_null(S.hours_between("admittime", "dischtime")),
    })


def collapsed_features(
    cohort: DataFrame, measures: Iterable[str] = VITALS, constants: Iterable[str] | None = None, text="note_text"
) -> DataFrame:
    """Cohort rows to one row per stay, with text sizes."""
    varying = {
        "icu_stay_id", "icu_intime", "icu_outtime", "length_of_icu_stay_hours", "icu_stay_count", "row_grain",
        "grain_id", "hadm_id", *measures,
    }
    df = add_durations(cohort)
    constants = list(constants) if constants is not None else [c for c in df.columns if c not in varying]
    out = A.collapse_intervals(
        df, order=["grain_id"], constants=constants, measures=measures, interval_id="icu_stay_id"
    )
    return out.withColumns({"note_length": F.length(text), "word_count": S.word_count(text)})


def first_visit_table(
    df: DataFrame, person="subject_id", stay="hadm_id", order=("admittime", "row_id"), positive="admit_to_disch_hours",
    row_first: bool = False,
) -> DataFrame:
    """All rows of persons with one stay, and one row of the others, without non-positive durations.

    The one row takes the first non-null value of each column, or with `row_first` the whole first row.
    """
    stays = df.groupBy(person).agg((F.count_distinct(stay) > 1).alias("_many"))
    tagged = df.join(stays, person)
    single = tagged.filter(~F.col("_many")).drop("_many")
    many = tagged.filter("_many").drop("_many")
    if row_first:
        first = A.argmin_row(many, person, order)
    else:
        first = A.first_non_null(many, person, order, df.columns)
    return X.drop_nonpositive(single.unionByName(first.select(*single.columns)), positive)
