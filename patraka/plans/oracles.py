"""The same queries as DuckDB SQL, written apart from the Spark expressions."""

from __future__ import annotations

from patraka.functions import lexicons as lex
from patraka.functions.text import DOUBLE_DANDA, MARKS
from patraka.operators.spelling import LAYERS, REASONS
from patraka.plans import alignment_oracles as alignment
from patraka.plans import projections as P
from patraka.plans.queries import TOP_N, UTTERANCE

SQL: dict[str, str] = {}


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def blanked(x: str, marks: str) -> str:
    return f"trim(regexp_replace(lower(translate({x}, {q(marks)}, {q(' ' * len(marks))})), '\\s+', ' ', 'g'))"


def words_of(x: str) -> str:
    return f"list_filter(string_split(trim(regexp_replace({x}, '\\s+', ' ', 'g')), ' '), lambda w: w <> '')"


def in_list(x: str, words) -> str:
    return f"{x} in ({', '.join(map(q, words))})"


def rows_of(name: str, columns: str, rows) -> str:
    body = ", ".join("(" + ", ".join(str(v) if isinstance(v, int) else q(v) for v in r) + ")" for r in rows)
    return f"{name}({columns}) as (values {body})"


def stripped(x: str) -> str:
    return f"regexp_replace(translate({x}, {q(MARKS + '.')}, ''), '^\\s+|\\s+$', '', 'g')"


def broken(x: str) -> str:
    return " or ".join(f"regexp_matches({x}, {q(p)})" for p in lex.BROKEN)


ENGLISH = f"regexp_matches({{x}}, {q('(' + '|'.join(lex.ENGLISH_ENDINGS) + ')$')})"
PURE = "regexp_matches({x}, '^[\\x{{0900}}-\\x{{097F}}\\x{{A8E0}}-\\x{{A8FF}}]*$')"
WORDS, TEXTS = f"with {P.WORDS}", f"with {P.TRANSCRIPTS}"

SQL["norm_wer_text"] = f"select doc_id, {blanked('nfc_normalize(text)', MARKS + DOUBLE_DANDA)} as norm from documents"
SQL["norm_align"] = f"select doc_id, {blanked('text', MARKS + '.')} as norm from documents"
SQL["strip_punct"] = f"{WORDS} select word, {stripped('word')} as clean, translate(word, '।,?!;:.-', '') as detector from words"
_TOKENS = words_of(blanked("text", MARKS + "."))
SQL["tokenize_counts"] = f"select doc_id, len(t)::bigint as n_tokens, len(list_distinct(t))::bigint as n_distinct from (select doc_id, {_TOKENS} as t from documents)"
SQL["script_profile"] = f"""
{WORDS}, counted as (select word, len(regexp_extract_all(word, '[\\x{{0900}}-\\x{{097F}}]')) as a, len(regexp_extract_all(word, '[a-zA-Z]')) as b from words)
select word, case when a + b = 0 then false else a > 0.5 * (a + b) end as devanagari, b > 0 as latin, {PURE.format(x='word')} as pure, not ({broken('word')}) as sound,
  {ENGLISH.format(x='word')} as english, regexp_matches(word, '[-_।.]') as joined, regexp_matches(word, '[0-9।,.!?;:]') as marks, contains(word, '{lex.NUKTA}') as nukta from counted"""

SQL["url_rewrite"] = "select page_id, replace(url, '.example.com/', '.example.org/moved/') as url from pages"
SQL["json_segments"] = f"with {P.SEGMENTS} select recording_id, segment_id, start_time, end_time, text from segments"
SQL["segment_filter"] = f"""
with {P.SEGMENTS}, bounded as (
  select recording_id, segment_id, trim(text, ' \n\t') as text, end_time - start_time as duration, greatest(trunc(start_time * 16000)::bigint, 0) as start_sample, least(trunc(end_time * 16000)::bigint, 3200000) as end_sample from segments)
select recording_id, segment_id, printf('%d_seg%04d.wav', recording_id, segment_id) as audio_path, text, duration, start_sample, end_sample
from bounded where duration between 1 and 30 and text <> '' and start_sample < end_sample"""
SQL["sigma_filter"] = f"""
with rows as (select conv_id, turn, text, {P.SECONDS} as duration from conversations), kept as (select * from rows where duration between 1 and 25 and length(trim(text, ' \n\t')) >= 2),
stats as (select avg(duration) as m, stddev_pop(duration) as s from kept)
select conv_id, turn, duration from kept, stats where duration between greatest(1, m - 1.5 * s) and least(25, m + 1.5 * s)"""
SQL["outlier_report"] = f"""
with rows as (select text, {P.SECONDS} as duration from conversations), kept as (select * from rows where duration between 1 and 25 and length(trim(text, ' \n\t')) >= 2),
stats as (select avg(duration) as m, stddev_pop(duration) as s from kept),
counts as (select (select count(*) from rows)::bigint as n_before, (select count(*) from kept, stats where duration between greatest(1, m - 1.5 * s) and least(25, m + 1.5 * s))::bigint as n_after)
select n_before, n_after, n_before - n_after as n_removed, round_even((n_before - n_after) * 100.0::double / greatest(n_before, 1) * 10, 0) / 10 as removed_pct from counts"""
SQL["input_lengths"] = f"select doc_id, len({_TOKENS})::bigint as input_length from documents where text is not null union all select doc_id, 0::bigint from documents where text is null"
SQL["non_empty"] = f"select doc_id from documents where length({blanked('nfc_normalize(text)', MARKS + DOUBLE_DANDA)}) > 0"
_MANIFEST = "manifest as (select event_id as recording_id, user_id, floor(abs(value) * 100) / 4 as duration from events)"
SQL["dataset_stats"] = f"""
with {_MANIFEST} select count(*)::double as num_recordings, count(distinct user_id)::double as num_unique_users, sum(duration)::double as total_duration_seconds,
round_even(sum(duration) / 3600 * 100, 0) / 100 as total_duration_hours, round_even(avg(duration) * 10, 0) / 10 as avg_duration_seconds, min(duration)::double as min_duration_seconds, max(duration)::double as max_duration_seconds from manifest"""
SQL["local_paths"] = "select event_id as recording_id, 'out/audio/' || event_id || '_audio.wav' as local_audio_path, 'out/transcriptions/' || event_id || '_transcription.json' as local_transcription_path, null::varchar as local_metadata_path from events"
SQL["existence_filter"] = "select event_id as recording_id, user_id from events where event_id in (select doc_id from documents)"
SQL["grouped_split"] = """
with groups as (select conv_id, row_number() over (order by md5('42|' || conv_id), conv_id) as r, count(*) over () as n from (select distinct conv_id from conversations))
select c.conv_id, c.turn, case when r <= floor(n * 0.9) then 'train' else 'val' end as split from conversations c join groups g using (conv_id)"""

# Words numbered within a pair become single bytes, as DuckDB's distance counts bytes.
_UTTERANCES = f"""
docs as (select doc_id, lang, {_TOKENS} as words from documents),
parts as (select doc_id, lang, words, unnest(range(0, greatest(ceil(len(words) / {UTTERANCE}), 1)::int)) as part from docs),
cut as (select doc_id || '-' || part as utt, doc_id + part as k, lang, words[part * {UTTERANCE} + 1:part * {UTTERANCE} + {UTTERANCE}] as human from parts),
utterances as (select utt, lang, human,
  list_filter(human, lambda w, i: (i - 1 + k % 5) % 5 <> 0) as m1,
  list_transform(human, lambda w, i: case when (i - 1 + k % 4) % 4 = 0 then w || 'x' else w end) as m2,
  list_transform(human, lambda w, i: case when (i - 1 + k % 7) % 7 = 0 then reverse(w) else w end) as m3 from cut),
outputs as (select utt, lang, human, 'm1' as model, m1 as hyp from utterances union all select utt, lang, human, 'm2', m2 from utterances union all select utt, lang, human, 'm3', m3 from utterances)"""


def distance(ref: str, hyp: str) -> str:
    symbols = lambda x: f"coalesce(array_to_string(list_transform({x}, lambda w: chr((32 + list_position(vocab, w))::int)), ''), '')"
    return f"levenshtein({symbols(ref)}, {symbols(hyp)})"


_MEASURED = f"""
{_UTTERANCES}, numbered as (select *, list_distinct(list_concat(human, hyp)) as vocab from outputs),
measured as (select utt, lang, model, human, hyp, {distance('human', 'hyp')}::bigint as errors, len(human)::bigint as n from numbered),
rated as (select *, case when n = 0 then 0.0::double else errors::double / n end as wer from measured)"""
SQL["seeded_sample"] = "select doc_id, lang from documents order by md5('42|' || doc_id), doc_id limit 50"
_BAND = "case when wer > 0 and wer <= 0.1 then 'Very Low' when wer > 0.1 and wer <= 0.3 then 'Low' when wer > 0.3 and wer <= 0.5 then 'Medium' when wer > 0.5 and wer <= 0.8 then 'High' when wer > 0.8 then 'Very High' end"
SQL["stratified_sample"] = f"""
with {_MEASURED}, banded as (select utt, wer, {_BAND} as stratum from rated where model = 'm1')
select utt, wer, stratum from (select *, row_number() over (partition by stratum order by md5('42|' || utt), utt) as r from banded where stratum is not null) where r <= 5"""
SQL["standard_wer"] = f"with {_MEASURED} select utt, model, errors, n as ref_length, len(hyp)::bigint as hyp_length, wer from rated"
SQL["sentence_wer"] = f"with {_MEASURED} select utt, model, case when n = 0 then 1.0::double else wer end as wer from rated"
SQL["wer_micro"] = f"with {_MEASURED} select model, coalesce(sum(errors)::double / nullif(sum(n), 0)::double, 0) as wer_micro from rated group by model"
SQL["wer_macro_by_group"] = f"with {_MEASURED} select lang, model, count(*)::bigint as n, avg(wer) as wer_macro, sum(errors)::double / nullif(sum(n), 0)::double as wer_micro from rated group by lang, model"
SQL["best_worst_model"] = f"with {_MEASURED}, means as (select model, avg(wer) as w from rated group by model) select (select model from means order by w, model limit 1) as best, (select model from means order by w desc, model desc limit 1) as worst"
SQL["unpivot_models"] = f"with {_UTTERANCES} select utt, model, coalesce(array_to_string(hyp, ' '), '') as hyp from outputs"
SQL["edit_distance_norm"] = "select p_partkey, case when p_name = p_type then 0.0::double when p_name = '' or p_type = '' then 1.0::double else levenshtein(p_name, p_type)::double / greatest(length(p_name), length(p_type)) end as distance from part"

_LATTICE = f"{_UTTERANCES}, columned as (select *, list_transform(range(1, len(human) + 1), lambda i: list_sort(list_distinct([human[i], m2[i], m3[i]]))) as lattice from utterances)"
SQL["lattice_string"] = f"""
with {_LATTICE} select utt, coalesce(array_to_string(list_transform(lattice, lambda b: case when len(b) = 1 then b[1] else '[' || array_to_string(b, '|') || ']' end), ' '), '') as lattice,
len(list_filter(lattice, lambda b: len(b) > 1))::bigint as with_alternatives from columned"""


def folded(source: str, hyp: str) -> str:
    """Rows of the distance table, one recursion for each word of ``hyp``."""
    return f"""
steps as (
  select utt, model, lattice, {hyp} as hyp, 0 as j, range(0, len(lattice) + 1) as prev from {source}
  union all
  select utt, model, lattice, hyp, j + 1,
    list_transform(range(0, len(lattice) + 1), lambda i: i + list_min(list_transform(range(0, i + 1), lambda k: best[k + 1] - k)))
  from (select *, list_concat([prev[1] + 1], list_transform(range(1, len(lattice) + 1), lambda i: least(prev[i] + case when list_contains(lattice[i], hyp[j + 1]) then 0 else 1 end, prev[i + 1] + 1))) as best from steps where j < len(hyp))),
folded as (select utt, model, len(lattice) as m, prev[len(lattice) + 1] as errors from steps where j = len(hyp))"""


SQL["lattice_wer"] = f"""
with recursive {_LATTICE}, one as (select *, 'm1' as model from columned), {folded('one', 'm1')}
select utt, errors::bigint as errors, m::bigint as lattice_length, case when m = 0 then 0.0::double else errors::double / m end as wer from folded"""
SQL["lattice_summary"] = f"""
with {_LATTICE}, two as (select utt, lattice, human, 'm2' as model, m2 as hyp from columned union all select utt, lattice, human, 'm3', m3 from columned),
numbered as (select *, list_distinct(list_concat(human, hyp)) as vocab from two),
-- every word of these models is in the lattice at its place, so that nothing is left to count
rated as (select model, case when len(human) = 0 then 0.0::double else {distance('human', 'hyp')}::double / len(human) end as s, 0.0::double as l from numbered),
means as (select model, round_even(avg(s) * 1e4, 0) / 1e4 as standard_wer, round_even(avg(l) * 1e4, 0) / 1e4 as lattice_wer, round_even(avg(s - l) * 1e4, 0) / 1e4 as wer_reduction from rated group by model)
select *, round_even((standard_wer - lattice_wer) / nullif(standard_wer, 0) * 100 * 100, 0) / 100 as improvement_pct from means"""

SQL["nw_align"] = f"""
with recursive {_UTTERANCES}, {alignment.PAIRS}
select utt, coalesce(array_to_string(list_transform(range(1, len(x) + 1), lambda i: coalesce(translate(x[i], said, own), '∅') || '/' || coalesce(translate(y[i], said, own), '∅')), ' '), '') as alignment from one_pairs, alphabet"""
_BUILT = f"with recursive {_UTTERANCES}, {alignment.LATTICES}"
SQL["msa_lattice"] = f"""
{_BUILT} select utt, coalesce(array_to_string(list_transform(lattice, lambda b: case when len(b) = 1 then b[1] else '[' || array_to_string(b, '|') || ']' end), ' '), '') as lattice from lattices"""
_BOTH = f"""
{_BUILT}, met as (select utt, model, human, hyp, lattice, list_distinct(list_concat(human, hyp)) as vocab from outputs join lattices using (utt)), {folded('met', 'hyp')},
compared as (select utt, model, len(human)::bigint as ref_length, case when len(human) = 0 then 0.0::double else {distance('human', 'hyp')}::double / len(human) end as standard_wer,
  case when f.m = 0 then 0.0::double else f.errors::double / f.m end as lattice_wer from met join folded f using (utt, model))"""
SQL["lattice_evaluation"] = f"{_BOTH} select utt, model, standard_wer, lattice_wer, standard_wer - lattice_wer as wer_reduction, ref_length from compared"
SQL["lattice_evaluation_summary"] = f"""
{_BOTH}, means as (select model, round_even(avg(standard_wer) * 1e4, 0) / 1e4 as standard_wer, round_even(avg(lattice_wer) * 1e4, 0) / 1e4 as lattice_wer, round_even(avg(standard_wer - lattice_wer) * 1e4, 0) / 1e4 as wer_reduction from compared group by model)
select *, round_even((standard_wer - lattice_wer) / nullif(standard_wer, 0) * 100 * 100, 0) / 100 as improvement_pct from means"""

# --- spelling --------------------------------------------------------------------------------------

_VOCAB = rows_of("core", "known", [(w,) for w in lex.vocabulary()])
_TOP = f"top as (select distinct clean as known from (select {stripped('word')} as clean from words where rank <= {TOP_N}) where length(clean) >= 2 and {PURE.format(x='clean')})"
SQL["freq_dictionary"] = f"{WORDS}, {_TOP} select known as word from top"
SQL["vocab_semi_join"] = f"{WORDS}, {_VOCAB} select word from words where word in (select known from core)"
SQL["vocab_anti_join"] = f"{WORDS}, {_VOCAB} select word from words where word not in (select known from core)"
SQL["structure_invalid"] = f"{WORDS} select word from (select word, {stripped('word')} as c from words) where {broken('c')}"
_SUFFIXES = [(s, i) for i, s in enumerate(lex.affixes("suffix"))]
_PREFIXES = [(p, i) for i, p in enumerate(lex.affixes("prefix"))]
_AFFIXES = rows_of("suffixes", "sfx, so", _SUFFIXES) + ", " + rows_of("prefixes", "pfx, po", _PREFIXES)
#: Splits whose root is in ``vocab``, with the place in the order in which they are tried.
_SPLITS = f"""
{_AFFIXES},
splits as (
  select word, 'morphology_suffix' as layer, left(c, length(c) - length(sfx)) as root, -length(sfx) * 1000 + so as ord, '' as pfx, sfx from cleaned, suffixes where ends_with(c, sfx) and length(c) > length(sfx) + 1
  union all
  select word, 'morphology_prefix', substr(c, length(pfx) + 1), -length(pfx) * 1000 + po, pfx, '' from cleaned, prefixes where starts_with(c, pfx) and length(c) > length(pfx) + 1
  union all
  select word, 'morphology_combined', left(rest, length(rest) - length(sfx)), po * 1000 + so, pfx, sfx from (select word, pfx, po, substr(c, length(pfx) + 1) as rest from cleaned, prefixes where starts_with(c, pfx)), suffixes where ends_with(rest, sfx) and length(rest) > length(sfx) + 1),
hits as (select s.* from splits s join vocab on root = known)"""
_CLEANED = f"cleaned as (select word, {stripped('word')} as c from words)"
for _layer, _name in (("morphology_suffix", "suffix_morph"), ("morphology_prefix", "prefix_morph"), ("morphology_combined", "combined_morph")):
    SQL[_name] = f"{WORDS}, {_VOCAB}, vocab as (select known from core), {_CLEANED}, {_SPLITS} select word, arg_min(root, ord) as root, count(*)::bigint as n_splits from hits where layer = '{_layer}' group by word"
_VARIANTS = f"""
{rows_of('bases', 'base, bo', [(b, i) for i, b in enumerate(lex.NUKTA_BASES)])},
variants as (
  select word, replace(c, '{lex.NUKTA}', '') as v, 0 as bo from cleaned where contains(c, '{lex.NUKTA}')
  union all select word, replace(c, base, base || '{lex.NUKTA}'), bo from cleaned, bases where not contains(c, '{lex.NUKTA}') and contains(c, base)),
varied as (select word, arg_min(v, bo) as variant from variants join vocab on v = known group by word)"""
SQL["nukta_variant"] = f"{WORDS}, {_VOCAB}, vocab as (select known from core), {_CLEANED}, {_VARIANTS} select word, variant from varied"
SQL["compound"] = f"""
{WORDS}, {_VOCAB}, {_CLEANED}, parts as (select word, unnest(string_split_regex(c, '[-_]')) as p from cleaned where regexp_matches(word, '[-_।.]'))
select word, count(*)::bigint as n_parts, count(known)::bigint as n_known from parts left join core on p = known group by word"""
_GRADES = rows_of("grades", "layer, classification, confidence", LAYERS)
_REASONS = rows_of("reasons", "layer, reason", list(REASONS.items()))
_CLASSIFIED = f"""
{WORDS}, {_VOCAB}, {_TOP}, vocab as (select known from core union select known from top), {_CLEANED}, {_SPLITS}, {_VARIANTS},
ways as (select *, case layer when 'morphology_suffix' then 'Root "' || root || '" and suffix "' || sfx || '"' when 'morphology_prefix' then 'Prefix "' || pfx || '" and stem "' || root || '"'
  else 'Prefix "' || pfx || '", core "' || root || '" and suffix "' || sfx || '"' end as said, case layer when 'morphology_suffix' then 0 when 'morphology_prefix' then 1 else 2 end as kind from hits),
morph as (select word, arg_min(layer, (kind, ord)) as layer, arg_min(said, (kind, ord)) as said from ways group by word),
parts as (select word, unnest(string_split_regex(c, '[-_]')) as p from cleaned where regexp_matches(word, '[-_।.]')),
compounds as (select word, count(known) || ' of ' || count(*) || ' parts known' as said from parts left join vocab on p = known group by word having count(known) >= 0.5 * count(*)),
layered as (select w.word, case
  when c = '' then 'punctuation' when c in (select known from vocab) then 'dictionary' when {in_list('c', lex.loanwords())} then 'english_transliteration'
  when {broken('c')} then 'structure_invalid' when regexp_matches(c, '[0-9।,.!?;:]') then 'mixed_content' when regexp_matches(c, '[a-zA-Z]') then 'mixed_script'
  when m.layer is not null then m.layer when {ENGLISH.format(x='c')} and {PURE.format(x='c')} then 'english_pattern' when {in_list('c', lex.numerals())} then 'number'
  when v.variant is not null then 'nukta_variant' when k.word is not null then 'compound' when length(c) = 1 and regexp_matches(c, '[ऄ-्ँंः़]') then 'single_char'
  when {PURE.format(x='c')} and length(c) <= 3 then 'short_word' when {PURE.format(x='c')} then 'unknown_devanagari' else 'unknown_nonstandard' end as layer, m.said as way, v.variant, k.said as counted
  from cleaned w left join morph m on w.word = m.word left join varied v on w.word = v.word left join compounds k on w.word = k.word),
{_GRADES}, {_REASONS},
verdicts as (select word, classification, confidence, coalesce(reason, case when layer like 'morphology%' then way when layer = 'nukta_variant' then 'Variant of "' || variant || '"' else counted end) as reason, layer
  from layered join grades using (layer) left join reasons using (layer))"""
SQL["spelling_classify"] = f"{_CLASSIFIED} select * from verdicts"
SQL["spelling_totals"] = f"""
{_CLASSIFIED}, by_confidence as (select confidence as k, count(*) as n from verdicts group by 1), by_layer as (select layer as k, count(*) as n from verdicts group by 1)
select count(*)::bigint as total_words, count(*) filter (classification = 'correct')::bigint as correct_spelling, count(*) filter (classification = 'incorrect')::bigint as incorrect_spelling,
round_even(coalesce(count(*) filter (classification = 'correct') * 100.0::double / nullif(count(*), 0), 0) * 100, 0) / 100 as correct_pct,
(select string_agg(k || '=' || n, ',' order by k) from by_confidence) as confidences, (select string_agg(k || '=' || n, ',' order by k) from by_layer) as layers from verdicts"""
SQL["spelling_stats"] = f"""
{_CLASSIFIED} select 'total' as kind, 'all' as value, count(*)::bigint as n from verdicts union all select 'classification', classification, count(*) from verdicts group by 2
union all select 'confidence', confidence, count(*) from verdicts group by 2 union all select 'layer', layer, count(*) from verdicts group by 2"""
SQL["low_confidence_sample"] = f"{_CLASSIFIED} select word, classification, layer from verdicts where confidence = 'low' order by md5('42|' || word), word limit 50"
SQL["failure_categories"] = f"""
{_CLASSIFIED} select count(*)::bigint as n, count(*) filter (regexp_matches(word, {q('(' + '|'.join(lex.DIALECT_ENDINGS) + ')$')}))::bigint as dialect,
count(*) filter (length(word) > 15)::bigint as long_words, count(*) filter (contains(word, '{lex.NUKTA}'))::bigint as nukta from verdicts where confidence = 'low'"""
SQL["word_lengths"] = f"{WORDS} select avg(length(word)) as mean, min(length(word))::bigint as least, max(length(word))::bigint as most, count(*) filter (length(word) = 1)::bigint as ones, count(*) filter (length(word) > 20)::bigint as over_20 from words"
SQL["review_confusion"] = "select quality = 1 as said, toxic = 0 as found, count(*)::bigint as n from labels group by 1, 2"

# --- numbers ---------------------------------------------------------------------------------------

_NUMERALS = rows_of("numerals", "numeral, value", list(lex.numerals().items()))
SQL["number_lookup"] = f"{WORDS}, {_NUMERALS} select word, value::bigint as value from words join numerals on trim(word) = numeral"
_IDIOM = q(lex.IDIOM)
_VALUE = f"(map {{{', '.join(f'{q(w)}: {v}' for w, v in lex.numerals().items())}}})"
_TAGGED = f"""
split as (select tid, text, {words_of('text')} as w from transcripts),
looked as (select tid, w, list_transform(w, lambda x: {_VALUE}[x]) as v from split),
tagged as (select tid, w, v, list_transform(w, lambda x, i: v[i] is not null and regexp_matches(array_to_string(w[greatest(1, i - 2):i + 4], ' '), {_IDIOM})) as idiom from looked)"""
SQL["idiom_window"] = f"{TEXTS}, {_TAGGED} select tid, array_to_string(list_transform(idiom, lambda x: case when x then '1' else '0' end), '') as flags from tagged"
_POWER = f"({', '.join(map(str, lex.POWERS))})"
_WALK = f"""
with recursive {P.TRANSCRIPTS}, {_TAGGED},
walk as (
  select tid, w, v, idiom, 0 as i, []::varchar[] as done, []::varchar[] as notes, null::hugeint as now, 0::hugeint as total, []::varchar[] as held from tagged
  union all
  select tid, w, v, idiom, i,
    case when power or more then done else list_concat(case when now is null then done else list_append(done, (total + now)::varchar) end, case when x is null or guard then [word] else []::varchar[] end) end,
    case when power or more then notes else list_concat(case when now is null then notes else list_append(notes, array_to_string(held, ' ') || '=' || (total + now)::varchar || ':number_conversion') end, case when x is not null and guard then [word || '=' || word || ':preserved_idiom'] else []::varchar[] end) end,
    case when power then (case when now = 0 then 1 else now end) * x when more then x when x is not null and not guard then x end,
    case when power then total when more then total + now else 0 end,
    case when power or more then list_append(held, word) when x is not null and not guard then [word] else []::varchar[] end
  from (select *, coalesce(now is not null and x in {_POWER}, false) as power, coalesce(now is not null and x not in {_POWER} and now > x, false) as more
    from (select tid, w, v, idiom, i + 1 as i, done, notes, now, total, held, w[i + 1] as word, v[i + 1]::hugeint as x, idiom[i + 1] as guard from walk where i < len(w)))),
ended as (select tid, case when now is null then done else list_append(done, (total + now)::varchar) end as done,
  case when now is null then notes else list_append(notes, array_to_string(held, ' ') || '=' || (total + now)::varchar || ':number_conversion') end as notes from walk where i = len(w))"""
SQL["number_normalize"] = f"{_WALK} select tid, array_to_string(done, ' ') as normalized from ended"
SQL["number_annotations"] = f"""
{_WALK} select tid, array_to_string(notes, ';') as notes, len(list_filter(notes, lambda n: ends_with(n, ':number_conversion')))::bigint as number_conversion,
len(list_filter(notes, lambda n: ends_with(n, ':preserved_idiom')))::bigint as preserved_idiom from ended"""

SQL["converted_transcripts"] = f"{_WALK} select tid from ended where len(list_filter(notes, lambda n: ends_with(n, ':number_conversion'))) > 0"
SQL["idiom_transcripts"] = f"{_WALK} select tid from ended where len(list_filter(notes, lambda n: ends_with(n, ':preserved_idiom'))) > 0"

# --- English words ---------------------------------------------------------------------------------

_LOAN = rows_of("loan", "known, english, ord", [(k, v, i) for i, (k, v) in enumerate(lex.loanwords().items())])


def detected(source: str, column: str) -> str:
    return f"""
spoken as (select tid, {column} as text, {words_of(column)} as w from {source}),
placed as (select tid, unnest(w) as word, generate_subscripts(w, 1) - 1 as position from spoken),
cleaned as (select *, translate(word, '।,?!;:.-', '') as c from placed),
kinds as (select distinct c from cleaned where c <> ''),
close as (select c, arg_min(english, ord) as english from kinds join loan on length(c) > 3 and length(known) > 3 and starts_with(c, known) and length(c) - length(known) <= 3 group by c),
found as (select tid, position::int as position, word, cleaned.c as clean_word,
  case when regexp_matches(cleaned.c, '[a-zA-Z]') then lower(cleaned.c) when l.known is not null then l.english else k.english || ' (variant)' end as english,
  case when regexp_matches(cleaned.c, '[a-zA-Z]') then 'latin_script' when l.known is not null then 'lookup_table' else 'partial_match' end as detection_method
  from cleaned left join loan l on cleaned.c = l.known left join close k on cleaned.c = k.c where cleaned.c <> '' and (regexp_matches(cleaned.c, '[a-zA-Z]') or l.known is not null or k.c is not null)),
marked as (select p.tid, string_agg(case when f.tid is null then p.word else '[EN]' || p.word || '[/EN]' end, ' ' order by p.position) as tagged, count(f.tid) as n from placed p left join found f on p.tid = f.tid and p.position = f.position group by p.tid)"""


_FOUND = f"{TEXTS}, {_LOAN}, {detected('transcripts', 'text')}"
SQL["english_detect"] = f"{_FOUND} select *, case when detection_method = 'partial_match' then 'medium' else 'high' end as confidence from found"
SQL["english_partial"] = f"{_FOUND} select clean_word, english, count(*)::bigint as n from found where detection_method = 'partial_match' group by all"
SQL["english_transcripts"] = f"{_FOUND} select tid, count(*)::bigint as n_english from found group by tid"
SQL["english_tag"] = f"{_FOUND} select s.tid, case when coalesce(n, 0) = 0 then text else tagged end as tagged from spoken s left join marked m on s.tid = m.tid"
SQL["english_summary"] = f"""
{_FOUND} select count(*)::bigint as n, count(*) filter (coalesce(m.n, 0) > 0)::bigint as with_english, sum(coalesce(m.n, 0))::bigint as english_words,
avg(case when len(w) = 0 then 0 else coalesce(m.n, 0)::double / len(w) end) as mean_ratio from spoken s left join marked m on s.tid = m.tid"""
SQL["cleanup_pipeline"] = f"""
{_WALK}, numbered as (select tid, array_to_string(done, ' ') as text, len(notes) as notes from ended), {_LOAN}, {detected('numbered', 'text')}
select s.tid, s.text as numbers_normalized, case when coalesce(m.n, 0) = 0 then s.text else tagged end as after_cleanup, b.notes::bigint as n_notes, coalesce(m.n, 0)::bigint as n_english
from spoken s left join marked m on s.tid = m.tid join numbered b on s.tid = b.tid"""
_RUNS = "list_transform(range(1, len(r) + 1), lambda i: coalesce(r[i] = r[i - 1], false))"
SQL["repeats_collapsed"] = f"""
{TEXTS}, split as (select tid, {words_of('text')} as w from transcripts),
placed as (select tid, unnest(w) as x, generate_subscripts(w, 1) as i from split),
repeated as (select tid, x, i, unnest(range(0, (tid + i - 1) % 4 + 1)) as k from placed),
ranked as (select tid, x, row_number() over (partition by tid order by i, k) as p from repeated),
islands as (select *, p - row_number() over (partition by tid, x order by p) as g from ranked),
runs as (select tid, x, min(p) as p, count(*) as n from islands group by tid, x, g)
select tid, string_agg(case when n >= 3 then x else trim(repeat(x || ' ', n::int)) end, ' ' order by p) as collapsed from runs group by tid"""
