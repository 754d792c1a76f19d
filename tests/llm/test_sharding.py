import random
import zlib
from collections import Counter, defaultdict

from standcarbon.llm import sharding as S

from .corpus import awkward_rows, prose, table


def test_pack_balances_three_sizes():
    rng = random.Random(1)
    pieces = []
    for i in range(3000):
        size = int(rng.paretovariate(1.5) * 1000)
        pieces.append(S.Piece(i, -1, (size, size // rng.randint(3, 8), rng.randint(1, 9))))
    for d, most in ((0, 1.01), (1, 1.1), (2, 1.1)):
        load = [0] * 16
        for p, s in zip(pieces, S.pack(pieces, 16), strict=True):
            load[s] += p.sizes[d]
        assert max(load) / min(load) < most
    assert S.pack([], 16) == []


def test_contract(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, rng.randint(1, 200)), "en", "s", 1) for i in range(1500)]
    rows += [(i, rows[i % 100][1], "en", "s", 1) for i in range(1500, 1600)]
    rows += [(i, "copy " * 40, "en", "s", 1) for i in range(1600, 2400)]  # a third of all rows
    got = S.shard_documents(table(spark, rows, clashing=True)).collect()
    slots, sizes = defaultdict(list), Counter()
    for r in got:
        text = rows[r.doc_id][1].encode()
        assert (r["size"], r.text_crc32, r.law) == (len(text) + 1, zlib.crc32(text), "bytes")
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r["size"]
    assert set(slots) == set(range(16)) and len(got) == len(rows)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sizes.values()) / min(sizes.values()) < 1.02
    homes = defaultdict(set)
    for r in got:
        homes[rows[r.doc_id][1]].add(r.shard)
    assert all(len(h) == 1 for t, h in homes.items() if not t.startswith("copy "))
    assert len(homes["copy " * 40]) > 4


def test_awkward_tables(spark):
    rows = awkward_rows()
    got = S.shard_documents(table(spark, rows, clashing=True)).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    assert {r["size"] for r in got if r.doc_id in (0, 1)} == {1}
    assert {r.text_crc32 for r in got if r.doc_id in (0, 1)} == {0}
    assert len({(r.shard, r.slot) for r in got}) == len(rows)
    assert S.shard_documents(table(spark, [])).count() == 0


def test_short_copies_do_not_crowd_a_shard(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.randint(100, 300)), "en", "s", 1) for i in range(1600)]
    rows += [(i, rng.choice([None, ""]), "en", "s", 1) for i in range(1600, 2400)]
    got = S.shard_documents(table(spark, rows)).collect()
    n, sizes = Counter(r.shard for r in got), Counter()
    for r in got:
        sizes[r.shard] += r["size"]
    assert max(n.values()) / min(n.values()) < 1.3
    assert max(sizes.values()) / min(sizes.values()) < 1.02


def test_tokens_are_words(spark):
    texts = ["a b", "a\nb\tc", "  a   b ", "", None, "日本語 x"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [r.tokens for r in df.select(S.text_facts(df.text)["tokens"].alias("tokens")).collect()]
    assert got == [2, 3, 2, 0, 0, 2]


def test_words_are_counted_without_holding_them(spark):
    texts = ["a\x0bb\x0c\rc", " " * 9000 + "x $1 \\\\2", "a\x85b\xa0c\u2028d\x1c e", "w " * 30000, "\t\n "]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    counted = df.select(S.text_facts(df.text)["tokens"].alias("tokens"))
    assert [r.tokens for r in counted.collect()] == [3, 3, 2, 30000, 0]
    # regexp_count is the size of an array of all words.
    assert "regexp_extract_all" not in counted._jdf.queryExecution().optimizedPlan().toString()


def test_slots_keep_the_order_of_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "ROWS_PER_RUN", 7)
    rng = random.Random(6)
    rows = [(i, prose(rng, rng.choice([5, 300])), "en", "s", 1) for i in range(600)]
    # Files of very unequal sizes: Spark reads the large ones first.
    docs = table(spark, rows).repartitionByRange(12, "doc_id").sortWithinPartitions("doc_id")
    docs.write.parquet(f"{tmp_path}/docs")
    for made in (docs, spark.read.parquet(f"{tmp_path}/docs")):
        slots = defaultdict(list)
        for r in S.shard_documents(made, 4, ordered=True).collect():
            slots[r.shard].append((r.slot, r.doc_id))
        for own in slots.values():
            ids = [i for _, i in sorted(own)]
            assert ids == sorted(ids) and [s for s, _ in sorted(own)] == list(range(len(own)))
        assert sum(map(len, slots.values())) == 600


def test_shards_follow_the_mixture(spark, tmp_path):
    """The pipeline's last two stages: every shard has the target mix along its slots."""
    import corpus_pipeline

    rng = random.Random(7)
    rows = [(i, prose(rng, 150), "en", f"s{i * 2 // 2000}", 1) for i in range(2000)]
    mixed = corpus_pipeline.mixing_to_weights(spark, table(spark, rows), "")
    mixed.write.parquet(f"{tmp_path}/mixed")
    mixed = spark.read.parquet(f"{tmp_path}/mixed")
    at = defaultdict(list)
    for i, r in enumerate(mixed.coalesce(1).sortWithinPartitions("_metadata.file_name", "_metadata.row_index").collect()):
        at[r.doc_id].append(i)
    slots = defaultdict(list)
    for r in corpus_pipeline.shards(spark, mixed, "").collect():
        slots[r.shard].append((r.slot, r.doc_id))
    for own in slots.values():
        order = [at[i][0] for _, i in sorted(own) if len(at[i]) == 1]
        assert order == sorted(order) and len(order) > 50
