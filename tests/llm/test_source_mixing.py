import random

from clickweave.llm.source_mixing import mix_documents, mix_report, mix_sources, shard_counts


def targets(sizes, weights=(5, 2, 1), most=3):
    """By name (NULL last): shares of all words, the excess over three times the size shared again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(most * sizes[s] for s in capped)
        want = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = {s for s in free if want[s] > most * sizes[s]}
        if not over:
            return want | {s: float(most * sizes[s]) for s in capped}
        capped |= over


def rows(seed, n=300, sources=("a", "b", "B", "é", None, "z", "tiny")):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        source = "a" if rng.random() < 0.4 else rng.choice(sources)
        size = 1 if source == "tiny" else rng.choice([0, 1, 3, 50, 200])
        out.append((i, None if rng.random() < 0.02 else " ".join(f"w{i}_{j}" for j in range(size)), "en", source))
    return out + [(5000, "long " * 3000, "en", "b"), (5001, "x y", "en", "z"), (5001, "x y", "en", "z"), (None, "p q r", "en", "z")]


def size_of(text):
    return len((text or "").encode().split())


def test_targets_sizes_and_taken(make_docs, table):
    data = rows(1)
    sizes = {}
    for _, t, _, s in data:
        sizes[s] = sizes.get(s, 0) + size_of(t)
    want = targets(sizes)
    docs = table(make_docs(data, extra=("size", "rid", "sid")))
    for block in (16, 512):
        got = mix_report(mix_sources(docs, block_words=block, bucket_rows=20)).collect()
        assert len(got) == len(data)
        by_id = {i: (size_of(t), s) for i, t, _, s in data}
        taken = {}
        for r in got:
            size, source = by_id[r.doc_id]
            assert (r.size, r.source_size) == (size, sizes[source])
            assert abs(r.target - want[source]) < 1e-6 * max(1, want[source])
            assert 0 <= r.taken <= 3 * r.size
            taken[source] = taken.get(source, 0) + r.taken
        assert all(abs(taken[s] - want[s]) <= 0.5 for s in sizes)
        assert any(r.taken % max(r.size, 1) for r in got)  # a pass in part


def test_capped_sources_take_everything_three_times(make_docs, table):
    docs = table(make_docs([(1, "a b c", "en", "p"), (2, "d " * 500, "en", "q"), (3, "e f", "en", "p")]))
    got = {r.doc_id: r for r in mix_report(mix_sources(docs, block_words=2)).collect()}
    assert got[1].taken == 9 and got[3].taken == 6 and got[1].target == 15
    assert got[2].taken == 505 - 15


def test_reruns_agree_and_do_not_depend_on_partitions(spark, make_docs, table):
    data = [r for r in rows(2) if r[0] not in (None, 5001)]
    a = {r.doc_id: r.taken for r in mix_report(mix_sources(table(make_docs(data)), block_words=32)).collect()}
    b = {r.doc_id: r.taken for r in mix_report(mix_sources(table(make_docs(data).repartition(7)), block_words=32)).collect()}
    assert a == b


def test_each_pass_takes_each_block_at_most_once(make_docs, table):
    mix = mix_sources(table(make_docs(rows(3))), block_words=8, shard_slots=50)
    slots = mix.slots.collect()
    assert len({(s.sid, s.epoch, s.block) for s in slots}) == len(slots)
    blocks = {r.sid: -(-r.source_size // 8) for r in mix.sources.collect()}
    assert all(0 <= s.block < blocks[s.sid] for s in slots)
    in_order = sorted((s for s in slots if s.epoch == 0), key=lambda s: (s.sid, s.slot))
    assert [s.block for s in in_order] != sorted(s.block for s in in_order)
    counts = shard_counts(mix).collect()
    assert sum(c.blocks for c in counts) == len(slots) and len({c.shard for c in counts}) > 2


def test_report_holds_the_draw_of_the_shards(make_docs, table):
    data = [r for r in rows(5) if r[0] not in (None, 5001)]
    mix = mix_sources(table(make_docs(data)), block_words=8, shard_slots=50)
    got = mix_report(mix).collect()
    assert all(r.taken == sum(x.words for x in r.shards) and len({x.shard for x in r.shards}) == len(r.shards) for r in got)
    sids = {r.source: r.sid for r in mix.sources.collect()}
    of, words = {i: sids[s] for i, _, _, s in data}, {}
    for r in got:
        for x in r.shards:
            words[x.shard, of[r.doc_id]] = words.get((x.shard, of[r.doc_id]), 0) + x.words
    assert words == {(c.shard, c.sid): c.words for c in shard_counts(mix).collect()} and len({s for s, _ in words}) > 2


def test_mixed_documents_hold_the_words_taken(make_docs, table):
    data = rows(4)
    docs = table(make_docs(data, extra=("size", "_row", "_pass")))
    taken = {}
    for r in mix_report(mix_sources(docs, block_words=16)).collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.taken
    mixed = mix_documents(docs, block_words=16)
    assert mixed.columns == docs.columns
    got, words = {}, {i: set((t or "").split()) for i, t, _, _ in data}
    for r in mixed.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + size_of(r.text)
        assert set(r.text.split()) <= words[r.doc_id] and r.n_chars == len(r.text)
    assert got == {i: n for i, n in taken.items() if n}


def test_tables_without_words(make_docs, table):
    assert mix_report(mix_sources(table(make_docs([])))).collect() == []
    got = mix_report(mix_sources(table(make_docs([(1, None), (2, "", "en", None)])))).collect()
    assert [(r.size, r.target, r.taken) for r in got] == [(0, 0.0, 0)] * 2


def test_shards_are_of_one_size_and_their_sources_are_drawn(make_docs, table):
    mix = mix_sources(table(make_docs(rows(3))), block_words=8, shard_slots=50)
    slots, counts = mix.slots.collect(), shard_counts(mix).collect()
    sizes, of = {}, {}
    for c in counts:
        sizes[c.shard] = sizes.get(c.shard, 0) + c.blocks
        of.setdefault(c.sid, {})[c.shard] = c.blocks
    last = max(sizes)
    assert sorted(sizes) == list(range(last + 1)) and all(n == 50 for s, n in sizes.items() if s != last) and 0 < sizes[last] <= 50
    # a shard has a range of a source's slots, in order of the shards
    for sid, drawn in of.items():
        mine = sorted((s.slot, s.shard) for s in slots if s.sid == sid)
        assert [x for x, _ in mine] == list(range(sum(drawn.values())))
        assert [s for _, s in mine] == sorted(s for _, s in mine)
    # drawn, not dealt out evenly: about as far from the expected counts as multinomial draws are
    main = max(of, key=lambda s: sum(of[s].values()))
    share = sum(of[main].values()) / len(slots)
    full = [of[main].get(s, 0) for s in range(last)]
    spread = sum((n - 50 * share) ** 2 for n in full) / len(full)
    assert 0.2 < spread / (50 * share * (1 - share)) < 4


def test_an_id_with_most_rows_is_spread_over_buckets(spark, make_docs, table):
    """Also in words taken: every row is one of its own."""
    data = [(7, "a b c d e", "en", "s")] * 600 + [(1000 + i, "x y z", "en", "s") for i in range(200)] + [(None, "n n", "en", "s")] * 50
    docs = table(make_docs(data))
    mix = mix_sources(docs, block_words=4, bucket_rows=100)
    got = mix_report(mix).collect()
    assert len(got) == 850 and sum(r.taken for r in got) == sum(r.size for r in got) == 3700
    plan = mix.pieces._jdf.queryExecution().optimizedPlan().toString()
    assert "several" in plan
    runs = sorted(r["from"] for r in mix.pieces.where("rid >= 0").groupBy("block").agg({"from": "count"}).withColumnRenamed("count(from)", "from").collect())
    assert len(runs) == 925
