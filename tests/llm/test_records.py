"""Dealt operators on small cases: nulls, empties, ties, repeats, empty tables, clashing columns."""

import itertools
import random
import time

import numpy as np
import pyspark.sql.functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella import session
from tessella.llm import formatting, groups, history, overlap, packing, quota, records, slots

FREE = "Добрый день, у мамы болит зуб 15, принимала Ставомедон, врач Лепежайкин, хочу прийти в среду после обеда на Лунной улице рядом с парком"
FORM = "врач: Лепежайкин; срок: третий день; жалоба: ноет"


def frame(spark, texts):
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts, 1)], "row_no bigint, text string")


def test_formatting(spark):
    texts = [
        FORM, '{"срок": "третий день", "жалоба": "НОЕТ", "врач": "Лепежайкин"}', "жалоба = ноет | врач = Лепежайкин! | срок = третий день",
        "\tЖалоба: ноет\nсрок: третий день\nврач: Лепежайкин\r\n", FREE, FREE.upper() + " !", FREE.replace("мамы", "ма​мы"), FREE.replace("мамы", "мама"),
        None, "", "  ", "...", "срок: день третий; врач: Лепежайкин; жалоба: ноет", "{bad", "a: 1; b", FREE * 200, (FREE * 200).lower(),
    ]
    df = frame(spark, texts).withColumn("_key", F.lit("x")).withColumn("value", F.lit(1))
    assert {tuple(r) for r in formatting.copies(df).collect()} == {(1, 2), (1, 3), (1, 4), (5, 6), (5, 7), (16, 17)}
    got = {r["first_row_no"]: r["copies"] for r in formatting.collapsed(df).collect()}
    assert got == {1: 4, 5: 3, 8: 1, 13: 1, 14: 1, 15: 1, 16: 2}
    assert formatting.copies(frame(spark, [])).count() == 0


def test_odd_characters_are_told_by_ranges(spark):
    """The look for odd characters finds each of them and nothing else, and takes a fraction of a class that lists them."""
    java, listed = spark._jvm.java.util.regex.Pattern, f"[{records.SPACES}{records.INVISIBLE}]"
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x11000)]))
    assert set(java.compile(records.ODD).matcher(every).replaceAll("")) == set(every) - set(records.SPACES + records.INVISIBLE)
    text = FREE * 2_000

    def took(pattern):
        looks = [java.compile(pattern).matcher(text) for _ in range(6)]
        began = [time.perf_counter() for m in looks if not m.find()]
        return min(b - a for a, b in itertools.pairwise(began))

    assert took(records.ODD) < took(listed) / 2


def edited(text, n, rng):
    w = text.split()
    for k in rng.sample(range(len(w) - 1), n):
        w[k] = w[k][::-1] + "х"
    return " ".join(w)


def words_of(spark, texts):
    rows = history.prepared(frame(spark, texts)).orderBy("row").collect()
    return [(set(np.frombuffer(r["words"], np.uint32).tolist()), r["nums"]) for r in rows]


def near(a, b):
    return bool(a[0]) and bool(b[0]) and a[1] == b[1] and 5 * len(a[0] & b[0]) >= 3 * len(a[0] | b[0])


def near_texts(seed, n=14):
    rng = random.Random(seed)
    vocab = ["".join(rng.sample("абвгдежзиклмнопрст", 7)) for _ in range(400)]
    out = []
    for k in range(n):
        b = " ".join(rng.sample(vocab, 30)) + f" {k % 3}"
        out += [b, edited(b, 2, rng), b.upper().replace(" ", ", "), edited(b, 1, rng), b + " 77"][: 1 + k % 5]
    return [*out, None, "", "!!", "да", "Да."]


def test_history_is_greedy_in_order(spark):
    texts = near_texts(3)
    sets = words_of(spark, texts)
    df = frame(spark, texts).withColumn("batch_no", (F.col("row_no") % 3).cast("int")).withColumn("key", F.lit(1)).withColumn("words", F.lit("x"))
    kept, gone = [], set()
    for k in sorted(range(len(texts)), key=lambda k: ((k + 1) % 3, k)):
        if any(near(sets[k], sets[j]) for j in kept):
            gone.add(k + 1)
        else:
            kept.append(k)
    assert gone and {r[0] for r in history.turned_away(df).collect()} == gone
    assert {r[0] for r in history.turned_away(df, most=2, crowd=0, buckets=3).collect()} == gone  # hot keys settled in rounds
    small = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")  # files are cut anywhere: no key may be parted
    old, history.ONE_TASK_EDGES, history.LISTED = (history.ONE_TASK_EDGES, history.LISTED), -1, -1
    try:
        assert {r[0] for r in history.turned_away(df, buckets=2).collect()} == gone  # all edges in rounds
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", small)
        history.ONE_TASK_EDGES, history.LISTED = old
    assert history.turned_away(df.where("false")).count() == 0


def test_history_of_gathered_batches(spark, monkeypatch, tmp_path):
    """Batches that wait are checked together: the same rows as one by one, in fewer checks."""
    texts = [t for k in range(4) for t in near_texts(11 + k % 3)]  # a quarter comes again in later batches
    batch = [1 + (k * 7919) % 10 // 2 if k % 2 else 0 for k in range(len(texts))]
    sets = words_of(spark, texts)
    kept, gone = [], set()
    for k in sorted(range(len(texts)), key=lambda k: (batch[k], -k)):
        (gone.add(-k) if any(near(sets[k], sets[j]) for j in kept) else kept.append(k)) if sets[k][0] else None
    df = spark.createDataFrame([(-k, t, b) for k, (t, b) in enumerate(zip(texts, batch, strict=True))], "row_no bigint, text string, batch_no int")
    checks, check = [], history.History._check
    monkeypatch.setattr(history.History, "_check", lambda self, reps, n: (checks.append(n), check(self, reps, n)))
    assert {r[0] for r in history.turned_away(df).collect()} == gone and len(gone) > len(texts) / 2 and len(checks) == 3
    assert {r[0] for r in history.turned_away(df, path=f"file://{tmp_path}/h").collect()} == gone and len(checks) == 3 + len(set(batch)) == 9
    few = [(5, 40, -3, 9), (6, 9, 0, 9), (7, 9, 0, 9), (8, 4, 0, 8), (9, 9, 0, 9)]
    assert history._gathered(few, False) == [(5, 0, 3), (6, 1, 16), (7, 1, 29), (8, 2, 42), (9, 2, 55)]
    assert history._gathered([(1, 1, 0, 1 << 62), (2, 1, 0, 1)], False) == [(1, 0, 0), (2, 1, 0)] and history._gathered([], False) == []


def at_the_limit(seed, n, gone=7):
    """Pairs of 30 words of which ``gone`` are exchanged all over the text: 7 leave 23 common words of 37."""
    rng = random.Random(seed)
    vocab = ["".join(rng.sample("абвгдежзиклмнопрст", 7)) for _ in range(4000)]
    a = [rng.sample(vocab, 30) for _ in range(n)]
    b = [[f"{w}ъ" if k in lost else w for k, w in enumerate(x)] for x in a for lost in [set(rng.sample(range(30), gone))]]
    return [" ".join(x) for x in a], [" ".join(x) for x in b]


def test_history_at_the_limit(spark):
    a, b = at_the_limit(8, 300)
    assert all(near(x, y) for x, y in zip(words_of(spark, a), words_of(spark, b), strict=True))
    df = frame(spark, a + b).withColumn("batch_no", (F.col("row_no") > len(a)).cast("int"))
    want = set(range(len(a) + 1, 2 * len(a) + 1))
    assert {r[0] for r in history.turned_away(df, bands=64).collect()} == want
    got = {r[0] for r in history.turned_away(df).collect()}  # 32 bands promise 0.994 at 23 words of 37
    assert got <= want and len(got) >= 0.98 * len(want)


def test_slots():
    def packed(rows):
        cols = [np.array(c, t) for c, t in zip(zip(*rows, strict=True), (np.uint32, np.int64, np.uint64, np.int32), strict=True)]
        return slots.opened(slots.closed(4, tuple(cols)))

    mine = packed([(1, 1, 0b1111, 4), (1, 2, 0b1110, 3), (1, 3, 0b110000, 2), (2, 1, 0b1111, 4), (2, 2, 0b1110, 3)])
    pairs, hot = slots.within(mine, 9, 9)
    assert pairs.tolist() == [[2, 1]] and not len(hot)
    pairs, hot = slots.within(mine, 2, 0)
    assert pairs.tolist() == [[2, 1]] and mine[1][hot].tolist() == [1, 2, 3]
    other = packed([(1, 9, 0b1111, 4), (3, 8, 0b1111, 4)])
    assert slots.between(mine, other).tolist() == [[1, 9], [2, 9]] and not len(slots.between(mine, other, crowd=0))
    assert slots.closed(1, packed([(1, 1, 1, 1)])).num_rows == 1 and slots.closed(1, tuple(c[:0] for c in mine)).num_rows == 0


def test_one_number_sorts_as_two():
    rng = np.random.default_rng(3)
    for wide in (40, 1 << 20, 1 << 50):  # rows that fit beside a key, and rows that don't
        high, low = rng.integers(0, 9, 500).astype(np.uint32), rng.integers(-wide, wide, 500)
        assert all((x[slots._order(high, low)] == x[np.lexsort((low, high))]).all() for x in (high, low))
        pairs = np.stack([low, rng.integers(-3, 3, 500)], 1)
        assert (slots._distinct(pairs) == np.unique(pairs, axis=0)).all() and not len(slots._distinct(pairs[:0]))


def test_history_by_batches(spark):
    h = history.History(spark)
    assert h.accepted().count() == 0
    first = h.add(history.prepared(frame(spark, [FREE, FREE.lower(), FORM, None])))
    assert {r[0] for r in first.collect()} == {2}
    later = frame(spark, [FORM.upper(), "совсем другое сообщение"]).withColumn("row_no", F.col("row_no") + 10)
    assert {r[0] for r in h.add(history.prepared(later)).collect()} == {11}
    assert {r[0] for r in h.accepted().collect()} == {1, 3, 12}


def test_history_is_opened_again(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/history"
    texts = [f"первое {w} второе {w}а третье {w}б четвёртое {w}в" for w in ("лес", "мост", "снег", "гора", "поле", "река")]
    count = itertools.count(0, 10)
    batch = lambda rows: history.prepared(frame(spark, [texts[k].upper() for k in rows]).withColumn("row_no", F.col("row_no") + next(count)))
    h = history.History(spark, path, buckets=3)
    assert h.add(batch([0, 1])).count() == 0 and h.add(batch([2])).count() == 0
    # a batch that breaks off after its keys are stored leaves nothing behind
    monkeypatch.setattr(history, "put_text", lambda *a: (_ for _ in ()).throw(OSError()) if "manifest" in a[1] else session.put_text(*a))
    try:
        h.add(batch([3]))
        raise AssertionError
    except OSError:
        monkeypatch.undo()
    for old, s in ((2, spark.newSession()), (4, spark)):
        again = history.History(s, path, bands=1)
        assert again.batches == old and again.meta["bands"] == history.BANDS
        assert again.add(batch([0, 1, 2, 2])).count() == 4  # copies from every earlier batch are turned away
        assert again.add(batch([3, 4, 5])).count() == (0 if old == 2 else 3)


def test_history_reads_touched_buckets_alone(spark, tmp_path):
    texts = near_texts(5, n=40)
    h = history.History(spark, f"file://{tmp_path}/history", buckets=400)
    h.add(history.prepared(frame(spark, texts)))
    probe = history.prepared(frame(spark, [texts[0]]).withColumn("row_no", F.lit(1000).cast("bigint")))
    keys = slots.slotted(probe, slots.bands_of(slots.BANDS, slots.ROWS), ("words", "nums"), h.meta["slots"])
    need = {f"_{r[0]:05d}." for r in keys.select(F.pmod(F.hash("slot"), F.lit(400))).distinct().collect()}
    gone = 0
    for f in (tmp_path / "history/keys").glob("part-*"):
        if not any(n in f.name for n in need):
            f.write_bytes(b"unreadable")
            gone += 1
    assert gone > 300
    again = history.History(spark, f"file://{tmp_path}/history")
    assert again.add(probe).count() == 1


def test_overlap(spark):
    texts = near_texts(5)
    sets = words_of(spark, texts)
    df = frame(spark, texts).withColumn("rep", F.lit(1)).withColumn("source", F.when(F.col("row_no") % 4 == 0, "a"))
    train, evals = df.where("row_no % 2 = 1"), df.where("row_no % 2 = 0")
    want = {(a + 1, b + 1) for a, b in itertools.product(range(0, len(texts), 2), range(1, len(texts), 2)) if near(sets[a], sets[b])}
    o = overlap.Overlap(train, evals, extra=("source",))
    assert want and {tuple(r) for r in o.rows().collect()} == want
    rep = {r["source"]: r for r in o.report().collect()}
    assert sum(r["overlapping"] for r in rep.values()) == len({b for _, b in want}) and sum(r["rows"] for r in rep.values()) == evals.count()
    assert overlap.Overlap(train.where("false"), evals).rows().count() == 0
    assert overlap.Overlap(train, evals.where("false")).rows().count() == 0


def test_overlap_at_the_limit(spark):
    a, b = at_the_limit(9, 300)
    rng = random.Random(10)
    slots = [[["".join(rng.sample("абвгдежзиклмнопрст", 7)) for _ in range(10)] for _ in range(6)] for _ in range(3)]
    for x in (sum(x, []) for x in itertools.product(*slots)):  # all grams but those across slots stand on 36 rows, and those across are edited
        a.append(" ".join(x))
        b.append(" ".join(f"{w}ъ" if k in (4, 9, 10, 14, 19, 20, 25) else w for k, w in enumerate(x)))
    a.append(a[0])
    b.append(" ".join(sorted(a[1].split())))  # the words in another order
    train, evals = words_of(spark, a), words_of(spark, b)
    want = {(j + 1, k + 1) for j, x in enumerate(train) for k, y in enumerate(evals) if near(x, y)}
    assert len(want) >= 516 and {tuple(r) for r in overlap.Overlap(frame(spark, a), frame(spark, b).withColumn("row_no", F.col("row_no") + 1000)).rows().collect()} == {(j, k + 1000) for j, k in want}


def test_overlap_of_crowded_fingerprints(spark, monkeypatch):
    """A greeting of ten words on every record: its fingerprints are passed over, and no pair is lost for it."""
    rng = random.Random(12)
    vocab = ["".join(rng.sample("абвгдежзиклмнопрст", 7)) for _ in range(3000)]
    hello = " ".join(vocab[:10])
    a = [f"{hello} " + " ".join(rng.sample(vocab[10:], 25)) for _ in range(150)]
    b = [edited(x, 4, rng) if k % 3 else f"{hello} " + " ".join(rng.sample(vocab[10:], 25)) for k, x in enumerate(a)]
    train, evals = words_of(spark, a), words_of(spark, b)
    want = {(j + 1, k + 1001) for j, x in enumerate(train) for k, y in enumerate(evals) if near(x, y)}
    rows = lambda: {tuple(r) for r in overlap.Overlap(frame(spark, a), frame(spark, b).withColumn("row_no", F.col("row_no") + 1000)).rows().collect()}
    assert len(want) >= 100 and rows() == want
    monkeypatch.setattr(overlap, "CROWD", 0)  # no fingerprint joins anything
    assert rows() == want


def test_aligned():
    a = list(range(40))
    assert overlap.aligned(a, a)[1] == 40
    assert overlap.aligned(a, a[:10] + [99] + a[10:20] + a[25:])[1] == 35
    assert overlap.aligned([], a) == (0, 0) and overlap.aligned([1, 2], [2, 1])[1] == 1


def test_components(spark):
    rng = random.Random(2)
    for n in (0, 1, 60):
        pairs = [(rng.randint(1, 60), rng.randint(1, 60)) for _ in range(n)] + [(k, k + 1) for k in range(100, 100 + n)]
        parent = {}

        def root(x, parent=parent):
            while parent.setdefault(x, x) != x:
                x = parent[x]
            return x

        for a, b in pairs:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
        touched = {x for p in pairs if p[0] != p[1] for x in p}
        got = {r["v"]: r["component"] for r in groups.components(spark.createDataFrame(pairs, "u bigint, v bigint")).collect()}
        assert got == {x: root(x) for x in touched}


def test_groups_and_splits(spark):
    ids = ["seed_0000001", " SEED-1", "#0000002", "seed_0000002|seed_0000003", "3.0", "Seed №4", "var_seed_0000005_90abb2b1", None, "", "нет", "seed_", "NaN", "5", "unknown", "seed_0000004 / seed_0000009", "12"]
    df = spark.createDataFrame([(k, s, "faq" if k % 2 else None, "q") for k, s in enumerate(ids)], "row_no bigint, seed_id string, route_domain string, `group` string")
    got = {r[0]: r[1] for r in groups.shared_groups(df).collect()}
    one, two, four, five = (f"seed_{n:07d}" for n in (1, 2, 4, 5))
    assert got == {0: one, 1: one, 2: two, 3: two, 4: two, 5: four, 14: four, 6: five, 12: five}
    targets = spark.createDataFrame([("train", 0.6), ("test", 0.4)], "split_name string, share double")
    a = groups.assigned(df, targets, labels=["faq"]).collect()
    assert sorted(r["row_no"] for r in a) == list(range(len(ids)))
    by = {}
    for r in a:
        if r["group_seed"]:
            assert by.setdefault(r["group_seed"], r["split"]) == r["split"]
    assert groups.shared_groups(df.where("false")).count() == 0 and groups.assigned(df.where("false"), targets).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.tuples(st.integers(0, 4), st.integers(0, 4)), st.floats(0, 20), max_size=15))
def test_controlled_rounding(table):
    got = quota.controlled_round(table)
    near_int = lambda n, x: int(np.floor(x + 1e-9)) <= n <= int(np.ceil(x - 1e-9))
    assert all(near_int(got[k], x) for k, x in table.items())
    for axis in (0, 1):
        for v in {k[axis] for k in table}:
            assert near_int(sum(n for k, n in got.items() if k[axis] == v), sum(x for k, x in table.items() if k[axis] == v))
    assert near_int(sum(got.values()), sum(table.values()))


def test_quota(spark):
    rows = [("faq", "price")] * 5 + [("FAQ.", " Price\t")] * 5 + [("anamnesis", "symptom")] * 60 + [("anamensis", "sympotm")] * 10 + [(None, "price"), ("faq", ""), ("other", "price")] * 3
    df = spark.createDataFrame([(k, d, s, "z") for k, (d, s) in enumerate(rows)], "row_no bigint, route_domain string, subtype string, _d string")
    targets = spark.createDataFrame([("faq", "price", 0.7, 2), ("anamnesis", "symptom", 0.2, 1), ("booking", "cancel", 0.1, 1)], "route_domain string, subtype string, target_share double, min_rows int")
    s = {r["subtype"]: (r["rows"], r["short"]) for r in quota.shortfalls(df, targets).collect()}
    assert s == {"price": (10, True), "symptom": (70, False), "cancel": (0, True)}
    got = quota.drawn(df, targets, slots=4).collect()
    n = int(len(rows) * 0.2)
    assert len(got) == n == len({r["row_no"] for r in got}) and sum(r["subtype"] == "price" for r in got) == 10
    assert quota.drawn(df.where("false"), targets).count() == 0


def fewest(sizes, capacity):
    """Containers that are needed, by trying everything."""
    best = len(sizes)

    def place(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(sizes):
            best = len(rooms)
            return
        for i in sorted({r: i for i, r in enumerate(rooms) if r >= sizes[k]}.values()):
            place(k + 1, [*rooms[:i], rooms[i] - sizes[k], *rooms[i + 1 :]])
        place(k + 1, [*rooms, capacity - sizes[k]])

    place(0, [])
    return best


@settings(max_examples=120, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_bin_completion_is_exact_on_small_pools(sizes):
    sizes = sorted(sizes, reverse=True)
    b = packing.packed(np.array(sizes, np.int64), 20)
    need = fewest(sizes, 20) if sizes else 0
    assert len(set(b)) == need and all(sum(x for x, k in zip(sizes, b, strict=True) if k == n) <= 20 for n in set(b))
    uniq, count = np.unique(-np.array(sizes, np.int64), return_counts=True)
    assert not sizes or packing.lower_bound(-uniq, count, 20) <= need


def test_dominated_fillings():
    sizes, left = np.array([9, 7, 5, 4, 2]), np.array([0, 1, 0, 0, 0])
    assert packing.dominated([2, 4], sizes, left, 0) and packing.dominated([2], sizes, left, 2) and not packing.dominated([2], sizes, left, 1)
    assert packing.completions(np.array([9, 7, 5, 4, 2]), np.ones(5, int), 11)[0] == (0, [0, 4])


def test_packing(spark):
    rng = np.random.default_rng(1)
    worst = packing.packed(np.full(50, 60), 100)  # nothing shares a container
    assert len(set(worst)) == 50
    hard = spark.createDataFrame([(k, "x" * 60) for k in range(90)], "doc_id bigint, text string")
    one = spark.createDataFrame([("p", 100)], "pack_id string, capacity_tokens int")
    assert packing.containers(hard, one, pool=7).select("container").distinct().count() == 90
    sizes = rng.integers(1, 100, 500)
    b = packing.packed(sizes, 128)
    fill = np.bincount(b, weights=sizes)
    assert fill.max() <= 128 and (b >= 0).all() and len(fill) <= -(-sizes.sum() // 128) + 2
    texts = [None, "", " ", "я", "x" * 9, "x" * 10, "x" * 19, "x" * 20, "y" * 100, "x" * 3, "x" * 3]
    docs = spark.createDataFrame([(k, t, 1, "q") for k, t in enumerate(texts)], "doc_id bigint, text string, part int, pack_id string")
    packs = spark.createDataFrame([("ten", 10), ("big", 1000), ("none", 0)], "pack_id string, capacity_tokens int")
    p = packing.containers(docs, packs)
    rows = p.collect()
    assert {(r["pack_id"], r["doc_id"]) for r in packing.oversize(p).collect()} == {("ten", k) for k in (6, 7, 8)} | {("ten", 5)}
    for kind, cap in (("ten", 10), ("big", 1000)):
        fill, tokens = {}, {}
        for r in rows:
            if r["pack_id"] == kind:
                fill[r["container"]] = fill.get(r["container"], 0) + r["tokens"]
                tokens[r["doc_id"]] = tokens.get(r["doc_id"], 0) + r["tokens"]
        assert max(fill.values()) <= cap and tokens == {k: len(t.encode()) + 1 for k, t in enumerate(texts) if t}
    assert packing.containers(docs.where("false"), packs).count() == 0
