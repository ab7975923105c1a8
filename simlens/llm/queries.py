"""Registered queries of this package: each applies one operator, with its defaults, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simlens.llm import chat, decontaminate, html, jaccard, language, pieces, pii, quality, repair, tokenfile, topk, toxicity, whiten
from simlens.llm.common import held_out, read_table, shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokenfile.token_table(read_table(spark, sf_dir, "documents"), shared_folder(spark, "tokens"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    profiles = language.train_profiles(docs, ~held_out(F.col("doc_id")))
    return language.identify(docs, profiles, ["doc_id"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query
def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pieces.encode_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(read_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), ["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL["op3_decontamination"] = f"""
with words as (select doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
  items as (select item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark),
  sized as (select item_id, w, least(len(w), 10) as span from items where len(w) > 0),
  item_windows as (select distinct item_id, span, array_to_string(w[i:i + span - 1], ' ') as g from (select *, unnest(range(1, len(w) - span + 2)) as i from sized)),
  spans as (select distinct span from sized),
  doc_windows as (select doc_id, span, i, array_to_string(w[i:i + span - 1], ' ') as g from (select *, unnest(range(1, len(w) - span + 2)) as i from words, spans)),
  hits as (select doc_id, d.span, i, item_id from doc_windows d join item_windows using (span, g)),
  hit_words as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + span)) as p from (select distinct doc_id, span, i from hits)) group by doc_id),
  hit_items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as listed from (select distinct doc_id, item_id::varchar as item from hits) group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(listed, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from words left join hit_words using (doc_id) left join hit_items using (doc_id)
"""


@query
def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(-1).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"),
                                                              F.lit("</s>[INST] ok [/INST]").alias("text")) for i, r in enumerate(("user", "assistant"))])))
    return chat.conversation_digests(turns.unionByName(added), public_tokenizers.path("byte_bpe_50k.json"))


def _escaped(column: str) -> str:
    """Length that escaping adds, by SQL: control strings found in the text, each with its backslashes."""
    names = sorted([*chat.CONTROLS, "<|endoftext|>"], key=len, reverse=True)
    tails = "|".join("".join(f"\\{c}" if not c.isalnum() and c != "<" and c != ">" and c != "=" and c != "/" else c for c in n[1:]) for n in names)
    return f"len(regexp_extract_all({column}, '[<\\[]\\\\*({tails})'))"


SQL["op4_chat_format"] = f"""
with turns as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select -1, i, r, '</s>[INST] ok [/INST]' from (values (0, 'user'), (1, 'assistant')) v(i, r))
select conv_id, count(*)::bigint as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(length(text) + {_escaped("text")} + case role when 'assistant' then 7 when 'user' then 13 when 'system' then 15 else 17 + length(url_encode(role)) end)::bigint as formatted_chars
from turns group by conv_id
"""


@query
def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(read_table(spark, sf_dir, "pages"))


@query
def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


SQL["op9_top_k"] = """
with vectors as (select vec_id, [floor(64 * x::double)::bigint for x in embedding] as v from embeddings
    where vec_id is not null and embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
  scored as (select q.vec_id as query_id, c.vec_id, list_sum([p[1] * p[2] for p in list_zip(q.v, c.v)])::bigint as score
    from vectors q join vectors c on q.vec_id <> c.vec_id and len(q.v) = len(c.v) where q.vec_id % 20 = 0),
  ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored)
select query_id, rank::int as rank, vec_id, score from ranked where rank <= 20
"""


@query
def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(read_table(spark, sf_dir, "documents"))


@query
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    learned = ~held_out(F.col("doc_id"))
    model = quality.train(docs.where(learned), labels.where(learned), "quality")
    return quality.score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.whiten(read_table(spark, sf_dir, "embeddings"))


@query
def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.digests(repair.damage(read_table(spark, sf_dir, "conversations")))


SQL["op11_repair"] = """
with recursive bits as (select i::bigint as v, i, 0 as step from range(256) t(i)
    union all select case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end, i, step + 1 from bits where step < 8),
  crc as (select list(v order by i) as t from bits where step = 8),
  said as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as k from conversations),
  drawn as (select said.*, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(k, ''), lambda c: ascii(c)::bigint)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::bigint) % 20 as draw from said, crc),
  damaged as (select conv_id, turn, case draw when 4 then 'user' else role end as role,
      case draw when 1 then '' when 2 then translate(text, '.!?', '') else text end as text, unnest(range(case draw when 3 then 2 else 1 end)) as copy from drawn where draw <> 0),
  numbered as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as k from damaged),
  ordered as (select *, row_number() over (partition by conv_id, role, text order by k) as seen, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as trimmed from numbered),
  faulted as (select conv_id, turn, role, text, k, case left(role, 1) when 's' then 0 when 'u' then 1 when 'a' then 2 else 3 end as kind,
      case when trimmed = '' then 1 when seen > 1 then 2 when right(trimmed, 1) not in ('.', '!', '?') then 3 else 0 end as fault from ordered),
  counted as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 1) as blank, count(*) filter (fault = 2) as duplicate,
      count(*) filter (fault = 3) as truncated, count(*) filter (before is not null and (before, kind) not in ((0, 1), (1, 2), (2, 1))) as illegal
      from (select *, lag(kind) over (partition by conv_id order by k) as before from faulted) group by conv_id),
  inserted(state, letters, next, cost, piece) as (values (0, '', 0, 0, ''), (0, 'I', 2, 3, 'user:\n'), (0, 'II', 3, 6, 'user:\nassistant:\n'), (1, '', 1, 0, ''), (1, 'I', 2, 3, 'user:\n'),
      (1, 'II', 3, 6, 'user:\nassistant:\n'), (2, '', 2, 0, ''), (2, 'I', 3, 3, 'assistant:\n'), (3, '', 3, 0, ''), (3, 'I', 2, 3, 'user:\n')),
  letters(letter, kind, state, next, cost) as (select 'D', kind, state, state, 4 from range(4) a(kind), range(4) b(state) union all
      select 'R', kind, state, case state when 2 then 3 else 2 end, 3 from range(4) a(kind), range(4) b(state) union all
      values ('K', 0, 0, 1, 0), ('K', 1, 0, 2, 0), ('K', 1, 1, 2, 0), ('K', 1, 3, 2, 0), ('K', 2, 2, 3, 0)),
  ways as (select distinct conv_id, 0::bigint as k, 0::bigint as state, 0::bigint as cost, '' as audit, '' as repaired from conversations
    union all
    select conv_id, k, state, cost, audit, repaired from (
      select w.conv_id, f.k, l.next::bigint as state, (w.cost + i.cost + l.cost + case when f.fault = 3 and l.letter <> 'D' then 3 else 0 end)::bigint as cost, w.audit || i.letters || l.letter as audit,
        w.repaired || replace(i.piece, '\n', chr(10)) || case l.letter when 'D' then '' when 'K' then f.role || ':' || f.text || chr(10) else case l.next when 2 then 'user:' else 'assistant:' end || f.text || chr(10) end as repaired
      from ways w join faulted f on f.conv_id is not distinct from w.conv_id and f.k = w.k + 1 join inserted i on i.state = w.state
        join letters l on l.state = i.next and l.kind = f.kind and (l.letter = 'D' or f.fault not in (1, 2)))
    qualify row_number() over (partition by conv_id, k, state order by cost, audit) = 1),
  ends as (select w.conv_id, w.k, w.cost + i.cost as cost, w.audit || i.letters as audit, w.repaired || replace(i.piece, '\n', chr(10)) as repaired
      from ways w join inserted i on i.state = w.state and (i.next = 3 or w.state = 0 and i.next = 0)
    qualify row_number() over (partition by w.conv_id order by w.k desc, w.cost + i.cost, w.audit || i.letters) = 1)
select e.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated,
  coalesce(illegal, 0)::bigint as illegal, e.cost::bigint as cost, e.audit, sha256(left(e.repaired, greatest(length(e.repaired) - 1, 0))) as repaired_sha256
from ends e left join counted c on c.conv_id is not distinct from e.conv_id
"""


@query
def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    hidden = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(True))
    model = toxicity.train(docs.where(~hidden), labels.where(~hidden), "toxic")
    return toxicity.score(docs, model).select("doc_id", hidden.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
