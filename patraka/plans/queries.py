"""One query for each operator over the provided tables, whole tables and whole texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patraka.functions import codeswitch, numbers, wer
from patraka.functions import lexicons as lex
from patraka.functions import text as T
from patraka.operators import align, evaluation, ingest, sampling, spelling
from patraka.plans import projections as P
from patraka.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
TOP_N = 300
UTTERANCE = 30  # words of the utterances that documents are cut into
MODELS = ("m1", "m2", "m3")


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def big(c: Column, name: str) -> Column:
    return c.cast("long").alias(name)


# --- text ------------------------------------------------------------------------------------------


@query
def norm_wer_text(spark, d):
    return table(spark, d, "documents").select("doc_id", T.for_error_rate(F.col("text")).alias("norm"))


@query
def norm_align(spark, d):
    return table(spark, d, "documents").select("doc_id", T.for_alignment(F.col("text")).alias("norm"))


@query
def strip_punct(spark, d):
    return P.counted(spark, d).select("word", T.strip_marks(F.col("word")).alias("clean"), T.detector_clean(F.col("word")).alias("detector"))


@query
def tokenize_counts(spark, d):
    rows = table(spark, d, "documents").withColumn("t", T.tokens(F.col("text")))
    return rows.select("doc_id", big(F.size("t"), "n_tokens"), big(F.size(F.array_distinct("t")), "n_distinct"))


@query
def script_profile(spark, d):
    w = F.col("word")
    tests = {"devanagari": T.mostly_devanagari(w), "latin": T.has_latin(w), "pure": T.only_devanagari(w), "sound": T.sound_structure(w), "english": T.english_ending(w), "joined": T.joined(w), "marks": T.has_marks(w), "nukta": T.has_nukta(w)}
    return P.counted(spark, d).select("word", *(c.alias(k) for k, c in tests.items()))


# --- ingestion -------------------------------------------------------------------------------------


@query
def url_rewrite(spark, d):
    pages = table(spark, d, "pages").select("page_id", F.col("url").alias("rec_url_gcp"))
    return ingest.rewrite_links(pages, ".example.com/", ".example.org/moved/").select("page_id", F.col("rec_url_gcp").alias("url"))


@query
def json_segments(spark, d):
    rows = P.transcript_files(spark, d).select("recording_id", F.posexplode(ingest.segments(F.col("raw"))).alias("segment_id", "s"))
    return rows.select("recording_id", "segment_id", "s.start_time", "s.end_time", "s.text")


@query
def segment_filter(spark, d):
    files = P.transcript_files(spark, d).withColumn("segments", ingest.segments(F.col("raw"))).withColumn("total", F.lit(16_000 * 200).cast("long")).drop("raw")
    return ingest.valid_segments(files, total="total").select("recording_id", "segment_id", "audio_path", "text", "duration", "start_sample", "end_sample")


@query
def sigma_filter(spark, d):
    rows = table(spark, d, "conversations").selectExpr("conv_id", "turn", "text", f"{P.SECONDS} as duration")
    return ingest.without_outliers(rows, sigma=1.5).select("conv_id", "turn", "duration")


@query
def outlier_report(spark, d):
    rows = table(spark, d, "conversations").selectExpr("text", f"{P.SECONDS} as duration")
    return ingest.outlier_report(rows, sigma=1.5)


@query
def input_lengths(spark, d):
    rows = table(spark, d, "documents").select("doc_id", T.tokens(F.col("text")).alias("input_features"))
    return ingest.input_lengths(rows).select("doc_id", "input_length")


@query
def non_empty(spark, d):
    return tables.non_empty(table(spark, d, "documents").select("doc_id", "text")).select("doc_id")


def _manifest(spark, d):
    return table(spark, d, "events").selectExpr("event_id as recording_id", "user_id", "floor(abs(value) * 100) / 4 as duration")


@query
def dataset_stats(spark, d):
    got = ingest.dataset_statistics(_manifest(spark, d))
    return got.select(*(F.col(c).cast("double").alias(c) for c in got.columns))


@query
def local_paths(spark, d):
    return ingest.local_paths(_manifest(spark, d).select("recording_id"), "out", metadata=False)


@query
def existence_filter(spark, d):
    rows = ingest.local_paths(_manifest(spark, d).select("recording_id", "user_id"), "out").select("recording_id", "user_id", "local_audio_path")
    there = table(spark, d, "documents").select(F.format_string("out/audio/%s_audio.wav", F.col("doc_id").cast("string")).alias("path"))
    return ingest.existing(rows, there, "local_audio_path").select("recording_id", "user_id")


@query
def grouped_split(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn")
    return sampling.grouped_split(rows, "conv_id").select("conv_id", "turn", "split")


# --- sampling --------------------------------------------------------------------------------------


@query
def seeded_sample(spark, d):
    return sampling.sample(table(spark, d, "documents").select("doc_id", "lang"), "doc_id", 50)


@query
def stratified_sample(spark, d):
    return sampling.stratified(_errors(spark, d), "wer", "utt").select("utt", "wer", "stratum")


# --- spelling --------------------------------------------------------------------------------------


def _classified(spark, d):
    top = spelling.frequency_dictionary(P.words(spark, d), TOP_N)
    return spelling.classify(P.counted(spark, d), dictionary=[r["word"] for r in top.collect()])  # TOP_N words at most


@query
def freq_dictionary(spark, d):
    return spelling.frequency_dictionary(P.words(spark, d), TOP_N)


def _vocabulary(spark):
    return spark.createDataFrame([(w,) for w in lex.vocabulary()], "known string")


@query
def vocab_semi_join(spark, d):
    words = P.counted(spark, d).select("word")
    return words.join(F.broadcast(_vocabulary(spark)), F.col("word") == F.col("known"), "left_semi")


@query
def vocab_anti_join(spark, d):
    words = P.counted(spark, d).select("word")
    return words.join(F.broadcast(_vocabulary(spark)), F.col("word") == F.col("known"), "left_anti")


@query
def structure_invalid(spark, d):
    return P.counted(spark, d).where(~T.sound_structure(T.strip_marks(F.col("word")))).select("word")


def _layer(spark, d, layer):
    clean = T.strip_marks(F.col("word"))
    rows = P.counted(spark, d).withColumn("clean", clean).withColumn("m", F.filter(spelling.morphs(F.col("clean"), [layer]), lambda m: lex.among(m["root"], lex.vocabulary())))
    return rows.where(F.size("m") > 0).select("word", F.col("m")[0]["root"].alias("root"), big(F.size("m"), "n_splits"))


@query
def suffix_morph(spark, d):
    return _layer(spark, d, "morphology_suffix")


@query
def prefix_morph(spark, d):
    return _layer(spark, d, "morphology_prefix")


@query
def combined_morph(spark, d):
    return _layer(spark, d, "morphology_combined")


@query
def nukta_variant(spark, d):
    clean = T.strip_marks(F.col("word"))
    rows = P.counted(spark, d).withColumn("v", F.filter(spelling.nukta_variants(clean), lambda v: lex.among(v, lex.vocabulary())))
    return rows.where(F.size("v") > 0).select("word", F.col("v")[0].alias("variant"))


@query
def compound(spark, d):
    rows = P.counted(spark, d).where(T.joined(F.col("word"))).withColumn("parts", F.split(T.strip_marks(F.col("word")), "[-_]"))
    return rows.select("word", big(F.size("parts"), "n_parts"), big(F.size(F.filter("parts", lambda p: lex.among(p, lex.vocabulary()))), "n_known"))


@query
def spelling_classify(spark, d):
    return _classified(spark, d).select("word", "classification", "confidence", "reason", "layer")


@query
def spelling_stats(spark, d):
    return spelling.summary(_classified(spark, d))


@query
def spelling_totals(spark, d):
    row = spelling.totals(_classified(spark, d))
    said = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return row.select("total_words", "correct_spelling", "incorrect_spelling", "correct_pct", said("confidence_breakdown").alias("confidences"), said("layer_breakdown").alias("layers"))


@query
def low_confidence_sample(spark, d):
    low = _classified(spark, d).where("confidence = 'low'").select("word", "classification", "layer")
    return sampling.sample(low, "word", 50)


@query
def failure_categories(spark, d):
    low = _classified(spark, d).where("confidence = 'low'")
    w = F.col("word")
    return low.agg(big(F.count("*"), "n"), big(F.count_if(w.rlike("(" + "|".join(lex.DIALECT_ENDINGS) + ")$")), "dialect"), big(F.count_if(F.length(w) > 15), "long_words"), big(F.count_if(T.has_nukta(w)), "nukta"))


@query
def word_lengths(spark, d):
    n = F.length("word")
    return P.counted(spark, d).agg(F.avg(n).alias("mean"), big(F.min(n), "least"), big(F.max(n), "most"), big(F.count_if(n == 1), "ones"), big(F.count_if(n > 20), "over_20"))


@query
def review_confusion(spark, d):
    got = table(spark, d, "labels").withColumn("said", F.col("quality") == 1).withColumn("found", F.col("toxic") == 0)
    return got.groupBy("said", "found").agg(big(F.count("*"), "n"))


# --- numbers ---------------------------------------------------------------------------------------


@query
def number_lookup(spark, d):
    return P.counted(spark, d).select("word", numbers.number_value(F.col("word")).alias("value")).where("value is not null")


@query
def idiom_window(spark, d):
    rows = P.transcripts(spark, d).withColumn("w", T.split(F.col("text")))
    rows = rows.withColumn("f", F.transform("w", lambda w, i: F.when(lex.among(w, lex.numerals()) & numbers.idiomatic(F.col("w"), i), 1).otherwise(0)))
    return rows.select("tid", F.array_join(F.transform("f", lambda x: x.cast("string")), "").alias("flags"))


@query
def number_normalize(spark, d):
    return P.transcripts(spark, d).select("tid", numbers.to_digits(F.col("text")).alias("normalized"))


@query
def number_annotations(spark, d):
    rows = P.transcripts(spark, d).withColumn("c", numbers.converted(T.split(F.col("text"))))
    note = F.transform("c.notes", lambda n: F.concat(n["original"], F.lit("="), n["converted"], F.lit(":"), n["type"]))
    kind = lambda k: big(F.size(F.filter("c.notes", lambda n: n["type"] == k)), k)
    return rows.select("tid", F.array_join(note, ";").alias("notes"), kind("number_conversion"), kind("preserved_idiom"))


def _noted(spark, d, kind):
    rows = P.transcripts(spark, d).withColumn("number_notes", numbers.converted(T.split(F.col("text")))["notes"])
    return numbers.with_notes(rows, kind).select("tid")


@query
def converted_transcripts(spark, d):
    return _noted(spark, d, "number_conversion")


@query
def idiom_transcripts(spark, d):
    return _noted(spark, d, "preserved_idiom")


# --- English words ---------------------------------------------------------------------------------


def _analyzed(spark, d):
    return codeswitch.analyze(P.transcripts(spark, d), "text")


@query
def english_detect(spark, d):
    rows = _analyzed(spark, d).select("tid", F.explode("english_words").alias("e"))
    return rows.select("tid", "e.position", "e.word", "e.clean_word", "e.english", "e.detection_method", "e.confidence")


@query
def english_partial(spark, d):
    return english_detect(spark, d).where("detection_method = 'partial_match'").groupBy("clean_word", "english").agg(big(F.count("*"), "n"))


@query
def english_tag(spark, d):
    return _analyzed(spark, d).select("tid", "tagged")


@query
def english_transcripts(spark, d):
    return codeswitch.with_english(_analyzed(spark, d)).select("tid", big(F.col("english_word_count"), "n_english"))


@query
def english_summary(spark, d):
    rows = _analyzed(spark, d)
    return rows.agg(big(F.count("*"), "n"), big(F.count_if(F.col("english_word_count") > 0), "with_english"), big(F.sum("english_word_count"), "english_words"), F.avg("english_ratio").alias("mean_ratio"))


@query
def cleanup_pipeline(spark, d):
    rows = codeswitch.cleanup(P.transcripts(spark, d), "text")
    return rows.select("tid", "numbers_normalized", F.col("tagged").alias("after_cleanup"), big(F.size("number_notes"), "n_notes"), big(F.col("english_word_count"), "n_english"))


# --- error rates -----------------------------------------------------------------------------------


def _utterances(spark, d):
    """Runs of UTTERANCE words of whole documents as references, and three models' outputs with known kinds of errors."""
    words, n = F.col("words"), UTTERANCE
    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(words) / n).cast("int"), F.lit(1)) - 1), lambda p: F.slice(words, p * n + 1, n))
    rows = table(spark, d, "documents").select("doc_id", "lang", T.tokens(F.col("text")).alias("words")).select("doc_id", "lang", F.posexplode(parts).alias("part", "human"))
    rows = rows.repartition("doc_id", "part")  # a long document's utterances go to many tasks
    k = lambda n: ((F.col("doc_id") + F.col("part")) % n).cast("int")
    dropped = F.transform(F.filter(F.transform("human", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: (x["i"] + k(5)) % 5 != 0), lambda x: x["w"])
    changed = F.transform("human", lambda w, i: F.when((i + k(4)) % 4 == 0, F.concat(w, F.lit("x"))).otherwise(w))
    swapped = F.transform("human", lambda w, i: F.when((i + k(7)) % 7 == 0, F.reverse(w)).otherwise(w))
    utt = F.concat_ws("-", F.col("doc_id").cast("string"), F.col("part").cast("string"))
    return rows.select(utt.alias("utt"), "lang", "human", dropped.alias("m1"), changed.alias("m2"), swapped.alias("m3"))


def _long(spark, d, models=MODELS):
    return evaluation.long(_utterances(spark, d), models, ["utt", "lang", "human"])


def _measured(spark, d, models=MODELS):
    rows = _long(spark, d, models).withColumn("errors", wer.word_distance(F.col("human"), F.col("hyp")))
    return rows.withColumn("wer", wer.standard_wer(F.col("human"), F.col("errors")))


def _errors(spark, d):
    return _measured(spark, d, MODELS[:1])


@query
def edit_distance_norm(spark, d):
    return table(spark, d, "part").select("p_partkey", wer.normalized_distance(F.col("p_name"), F.col("p_type")).alias("distance"))


@query
def standard_wer(spark, d):
    return _measured(spark, d).select("utt", "model", big(F.col("errors"), "errors"), big(F.size("human"), "ref_length"), big(F.size("hyp"), "hyp_length"), "wer")


@query
def sentence_wer(spark, d):
    return _measured(spark, d).select("utt", "model", wer.sentence_wer(F.col("human"), F.col("errors")).alias("wer"))


@query
def wer_micro(spark, d):
    rows = _measured(spark, d).groupBy("model").agg(F.sum("errors").alias("e"), F.sum(F.size("human")).alias("n"))
    return rows.select("model", F.coalesce(F.try_divide(F.col("e"), F.col("n")), F.lit(0.0)).alias("wer_micro"))


@query
def wer_macro_by_group(spark, d):
    return _measured(spark, d).groupBy("lang", "model").agg(big(F.count("*"), "n"), F.avg("wer").alias("wer_macro"), F.try_divide(F.sum("errors"), F.sum(F.size("human"))).alias("wer_micro"))


@query
def unpivot_models(spark, d):
    joined = _utterances(spark, d).select("utt", *(F.array_join(m, " ").alias(m) for m in MODELS))
    return joined.unpivot("utt", list(MODELS), "model", "hyp")


def _columns(spark, d):
    """Lattices of the sequences that keep the reference's places: one bin for each."""
    rows = _utterances(spark, d)
    return rows.withColumn("lattice", F.transform(F.arrays_zip("human", "m2", "m3"), lambda x: F.sort_array(F.array_distinct(F.array(x["human"], x["m2"], x["m3"])))))


@query
def lattice_string(spark, d):
    return _columns(spark, d).select("utt", wer.lattice_text(F.col("lattice")).alias("lattice"), big(F.size(F.filter("lattice", lambda b: F.size(b) > 1)), "with_alternatives"))


@query
def lattice_wer(spark, d):
    rows = _columns(spark, d).withColumn("errors", wer.lattice_errors(F.col("lattice"), F.col("m1")))
    return rows.select("utt", big(F.col("errors"), "errors"), big(F.size("lattice"), "lattice_length"), wer.lattice_wer(F.col("lattice"), F.col("errors")).alias("wer"))


@query
def nw_align(spark, d):
    rows = _utterances(spark, d).withColumn("p", align.pairs(F.col("human"), F.col("m1")))
    return rows.select("utt", F.array_join(F.transform("p", lambda x: F.concat(F.coalesce(x["a"], F.lit("∅")), F.lit("/"), F.coalesce(x["b"], F.lit("∅")))), " ").alias("alignment"))


def _lattices(spark, d):
    rows = _utterances(spark, d)
    return rows.withColumn("lattice", align.lattice(F.array("human", *MODELS)))


@query
def msa_lattice(spark, d):
    return _lattices(spark, d).select("utt", wer.lattice_text(F.col("lattice")).alias("lattice"))


def _evaluated(spark, d):
    return evaluation.aligned_rates(_utterances(spark, d), "human", MODELS, ["utt"])


@query
def lattice_evaluation(spark, d):
    return _evaluated(spark, d).select("utt", "model", "standard_wer", "lattice_wer", "wer_reduction", "ref_length")


@query
def lattice_evaluation_summary(spark, d):
    return evaluation.summary(_evaluated(spark, d))


def _place_errors(spark, d):
    """Both error rates of the models that keep the reference's places."""
    return evaluation.rated(evaluation.long(_columns(spark, d), MODELS[1:], ["utt", "human", "lattice"]))


@query
def lattice_summary(spark, d):
    return evaluation.summary(_place_errors(spark, d))


@query
def best_worst_model(spark, d):
    rows = _measured(spark, d).groupBy("model").agg(F.avg("wer").alias("w"))
    return rows.agg(F.min_by("model", F.struct("w", "model")).alias("best"), F.max_by("model", F.struct("w", "model")).alias("worst"))


@query
def repeats_collapsed(spark, d):
    rows = P.transcripts(spark, d).withColumn("w", F.flatten(F.transform(T.split(F.col("text")), lambda w, i: F.array_repeat(w, ((F.col("tid") + i) % 4 + 1).cast("int")))))
    return rows.select("tid", F.array_join(T.collapse_repeats(F.col("w")), " ").alias("collapsed"))
