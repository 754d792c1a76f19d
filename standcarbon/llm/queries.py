"""The registered queries of the corpus operators, each over its whole table."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from standcarbon.llm import (
    alignment,
    decontam,
    lines,
    mixing,
    personal,
    prefix_trie,
    rules,
    secrets,
    sharding,
    simhash,
    token_counts,
    token_files,
    weak_labels,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if oracle is not None:
            ORACLES[function.__name__] = oracle
        return function

    return register


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query()
def op1_simhash(spark, folder):
    return simhash.near_duplicates(table(spark, folder, "documents"))


@query()
def op6_quality_rules(spark, folder):
    return rules.quality_verdicts(
        table(spark, folder, "documents"), table(spark, folder, "labels")
    )


@query()
def op7_sharding(spark, folder):
    return sharding.shard_documents(table(spark, folder, "documents"), 16)


@query()
def op8_token_files(spark, folder):
    documents = table(spark, folder, "documents")
    return token_files.token_file_digest(documents, tokenizer("byte_bpe_50k.json"), 2)


@query()
def op9_token_counts(spark, folder):
    documents = table(spark, folder, "documents")
    return token_counts.token_counts(documents, tokenizer("word_bpe_49k.json"), 2048)


@query()
def op4_secret_scan(spark, folder):
    return secrets.scan(table(spark, folder, "documents"))


@query()
def op5_decontamination(spark, folder):
    return decontam.contaminated(
        table(spark, folder, "documents"), table(spark, folder, "benchmark")
    )


@query()
def op10_line_dedup(spark, folder):
    return lines.line_report(table(spark, folder, "documents"))


# The schedule is played slot by slot; the state is the number of blocks given to each source.
# Weights are whole multiples of 1 / U with U = 2 ** 60.
_MIX = """
with recursive sized as (
  select doc_id, source, md5(coalesce(cast(doc_id as varchar), '')) as ord,
    strlen(coalesce(text, '')) + 1 as bytes from documents),
sizes as (select source, cast(sum(bytes) as bigint) as bytes, pow(sum(bytes), 0.7) as w
  from sized group by source),
parts as (select source, (bytes - 1) // 65536 + 1 as blocks, 1152921504606846976::hugeint as u,
  row_number() over (order by source nulls first) as i,
  greatest(1, floor(w / max(w) over () * 1152921504606846976)::hugeint)::hugeint as part from sizes),
cut as (select *, greatest(1, part * u // (sum(part) over ())::hugeint)::hugeint as low,
  row_number() over (order by part desc, i) as place from parts),
shares as (select source, blocks, i, u, low + case when place = 1
  then u - (sum(low) over ())::hugeint else 0 end as share from cut),
ended as (select *, max((blocks * u + share - 1) // share) over () as ends from shares),
facts as (select *, ends * share // u as due from ended),
one as (select list(share order by i) as shares, list(due order by i) as due, max(u) as u,
  max(ends) as ends from facts),
play(slot, given, pick) as (
  select 0::hugeint - 1, list_transform(shares, lambda x: 0::hugeint), 0::bigint from one
  union all
  select slot + 1, list_transform(given, lambda g, i: case when i = p then g + 1 else g end), p
  from (select play.slot, play.given, cast(list_min(list_transform(one.shares, lambda x, i:
      case when play.given[i] < one.due[i] and play.given[i] * one.u // x <= play.slot + 1
      then {'due': ((play.given[i] + 1) * one.u + x - 1) // x, 'i': i} end)).i as bigint) as p
    from play, one where play.slot + 1 < one.ends)),
plan as (select slot, pick as i, row_number() over (partition by pick order by slot) - 1 as k
  from play where slot >= 0 and pick is not null),
placed as (select doc_id, source, bytes, cast(coalesce(sum(bytes) over (partition by source
  order by ord, doc_id rows between unbounded preceding and 1 preceding), 0) as bigint) as pos
  from sized),
shown as (select p.doc_id, p.source, p.bytes, pos // 65536 as block, pos % 65536 as off, t.blocks,
  t.i, unnest(range(0, cast(1 + (due - 1 - pos // 65536) // blocks as bigint))) as epoch
  from placed p join facts t on p.source is not distinct from t.source)
select doc_id, source, bytes, cast(epoch as int) as epoch, block, off as "offset",
  cast(slot as bigint) as slot
from shown join plan on plan.i = shown.i and plan.k = block + epoch * blocks"""


@query(_MIX)
def op2_mixing(spark, folder):
    return mixing.mix_plan(table(spark, folder, "documents"))


@query()
def op3_quality_classifier(spark, folder):
    return weak_labels.classify(table(spark, folder, "documents"))


@query()
def op13_token_alignment(spark, folder):
    documents = table(spark, folder, "documents")
    return alignment.token_alignment(
        documents, tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model")
    )


@query()
def op11_conversation_trie(spark, folder):
    return prefix_trie.conversation_trie(table(spark, folder, "conversations"))


@query()
def op12_personal_data(spark, folder):
    return personal.find_personal_data(table(spark, folder, "documents"))
