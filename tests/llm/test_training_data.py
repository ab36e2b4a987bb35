"""Each operator against brute force on small, dirty tables: NULLs, empty and long texts, ties,
repeated rows, empty tables and extra columns with clashing names."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylight.llm import leaks, mixing, neardup, pii, quality, repetition, residue, seen

WORD = re.compile(r"[^\W_]+")


def sentence(rng, n):
    return " ".join(rng.choice(["red", "old", "map", "the", "door", "lamp", "runs", "blue", "over", "hill", "cat", "seven"]) + str(rng.randrange(40)) for _ in range(n))


def table(spark, rows, schema):
    """Rows over several partitions, with extra columns named like those operators make."""
    df = spark.createDataFrame(rows, schema).repartition(3)
    return df.withColumns({"part": F.lit(1), "name": F.lit("x"), "tokens": F.lit(2), "n": F.lit(None).cast("string"), "at": F.lit(0)})


# --- near-duplicates ----------------------------------------------------------------------------
def shingles(text, run):
    w = WORD.findall((text or "").lower())
    return frozenset(tuple(w[i:i + run]) for i in range(len(w) - run + 1)), len(w)


def brute_pairs(rows, join):
    out = set()
    sets = [(i, k, *shingles(t, join.run)) for i, k, t in rows if k is not None and t is not None]
    sets = [(i, k, s) for i, k, s, n in sets if n >= join.least]
    for x, (i, k, a) in enumerate(sets):
        for j, m, b in sets[:x]:
            if k == m and 100 * len(a & b) >= join.percent * len(a | b):
                out.add((min(i, j), max(i, j)))
    return out


def near_rows(seed=3):
    rng, rows = random.Random(seed), []
    for g in range(40):
        base = sentence(rng, rng.randrange(18, 60))
        for _ in range(rng.randrange(1, 5)):
            words = base.split()
            for _ in range(rng.randrange(0, 4)):
                words[rng.randrange(len(words))] = "edit" + str(rng.randrange(99))
            rows.append((len(rows) + 1, rng.choice(["a", "a", "b", None]), " ".join(words)))
    rows += [(1000 + i, "a", "copy " * 3 + "of one and the same rather long text that stands here many times over and over again as it does") for i in range(30)]
    return [*rows, (2000, "a", None), (2001, "a", ""), (2002, None, sentence(rng, 30)), (2003, "a", "long " + sentence(rng, 3000)), (2004, "a", "!!! --- ...")]


@pytest.mark.parametrize("join", [neardup.Join(run=3, percent=60, least=20), neardup.Join()])
def test_near_duplicates_equal_brute_force(spark, join, monkeypatch):
    rows = near_rows()
    df = table(spark, rows, "find_id long, kind string, text string")
    want = brute_pairs(rows, join)
    assert {tuple(r) for r in neardup.similar_pairs(df, join).collect()} == want
    assert len(want) > 400
    monkeypatch.setattr(neardup, "BLOCK", 2)  # many blocks, and lists cut in parts
    got = neardup.groups(df, join).collect()
    assert sum(r.links for r in got) == 2 * len(want)
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in want:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    assert {(r.id, r.class_id) for r in got} == {(x, root(x)) for x in parent}


def test_long_lists_are_cut_without_losing_pairs(monkeypatch):
    rng = np.random.default_rng(1)
    join = neardup.Join(run=3, percent=60, least=3)
    import pyarrow as pa

    bases = [[f"w{x}" for x in rng.integers(0, 12, 14)] for _ in range(50)]
    texts = [" ".join([*b[:-k], *(f"v{k}{x}" for x in range(k - 1))]) for b in bases for k in (1, 2, 3)]
    s = join.sets(pa.RecordBatch.from_pydict({"id": list(range(150)), "kind": ["k"] * 150, "text": texts}))
    counts = np.full(neardup.SLOTS, 150, np.uint32)

    def pairs():
        at, rows = join.postings(s, counts, 8)
        out = set()
        for b in np.unique(at):
            for x, y in join.pairs(rows[at == b]):
                out |= {tuple(sorted(p)) for p in zip(x.tolist(), y.tolist())}
        return out

    whole = pairs()
    monkeypatch.setattr(neardup, "LONG_LIST", 10)
    assert pairs() == whole and whole


def test_very_long_texts_keep_their_pairs():
    # 200,000 runs each, 160,000 in common; what is their own is rarer and comes first
    import pyarrow as pa

    join = neardup.Join(run=1, percent=60, least=1)
    shared = [f"c{x}" for x in range(160_000)]
    texts = [" ".join([*shared, *(f"{own}{x}" for x in range(40_000))]) for own in "ab"]
    s = join.sets(pa.RecordBatch.from_pydict({"id": [1, 2], "kind": ["k", "k"], "text": texts}))
    counts = np.full(neardup.SLOTS, 1, np.uint32)
    counts[neardup._slot(np.intersect1d(s.tokens[s.owner == 0], s.tokens[s.owner == 1]))] = 2
    at, rows = join.postings(s, counts, 1)
    assert len({tuple(sorted(p)) for x, y in join.pairs(rows) for p in zip(x.tolist(), y.tolist())}) == 1


def test_marks_rule_out_unlike_sets_before_tokens_move(spark):
    # sixty texts that share ten runs of some sixty, and a longer copy of twenty of them
    rng = random.Random(5)
    common = sentence(rng, 12)
    rows = [(i, "a", f"{common} {sentence(rng, 50)}") for i in range(60)]
    rows += [(100 + i, "a", f"{text} and so it ends") for i, _, text in rows[:20]]
    join = neardup.Join(run=3, percent=60, least=20)
    sets = join.table(join.source(table(spark, rows, "find_id long, kind string, text string")))
    number = {r.name: r.id for r in sets.collect()}
    got = join.candidates(sets, np.full(neardup.SLOTS, 2, np.uint32), len(rows)).collect()
    want = brute_pairs(rows, join)
    assert {tuple(sorted((number[r.a], number[r.b]))) for r in got} == want and len(want) == 20


def test_answers_are_derived_from_those_of_a_leader():
    rng = np.random.default_rng(9)
    join = neardup.Join(run=3, percent=60, least=3)
    tokens = {}
    for g in range(30):
        base = rng.integers(0, 1 << 60, int(rng.integers(8, 60)), dtype=np.uint64)
        for _ in range(int(rng.integers(2, 9))):
            own = base.copy()
            own[rng.random(len(own)) < rng.choice([0.02, 0.2, 0.4])] = rng.integers(0, 1 << 60, dtype=np.uint64)
            tokens[len(tokens) * 7 + int(rng.integers(5))] = np.unique(own)
    names = sorted(tokens)
    pairs = np.array([(x, y) for i, x in enumerate(names) for y in names[i + 1:] if rng.random() < 0.9])
    want = [100 * len(np.intersect1d(tokens[x], tokens[y])) >= 60 * len(np.union1d(tokens[x], tokens[y])) for x, y in pairs.tolist()]
    counts = {}
    assert join.verified(pairs[:, 0], pairs[:, 1], tokens, counts).tolist() == want and 50 < sum(want) < len(want)
    assert counts["bounds"] > counts["compared"]


def test_near_duplicates_of_nothing(spark):
    empty = spark.createDataFrame([], "find_id long, kind string, text string")
    assert neardup.similar_pairs(empty, neardup.Join()).count() == 0
    assert neardup.groups(empty, neardup.Join()).count() == 0


# --- seen keys ----------------------------------------------------------------------------------
def test_runs_merge_and_answer_exactly():
    rng = np.random.default_rng(5)
    a, b = (np.unique(rng.integers(0, 1 << 20, n, dtype=np.uint64)) for n in (500, 3000))
    x, y = seen.Run.of(a, 20), seen.Run.of(b, 20)
    both = x.merge(y)
    assert np.array_equal(both.fingerprints(), np.union1d(a, b))
    asked = np.arange(1 << 20, dtype=np.uint64)
    assert np.array_equal(np.flatnonzero(both.has(asked)).astype(np.uint64), np.union1d(a, b))
    assert np.array_equal(seen.Run.read(both.columns()).fingerprints(), both.fingerprints())
    assert both.nbytes < 8 * len(both) / 2
    assert not seen.Run.of(a[:0], 20).has(asked[:9]).any()


def test_seen_before_equals_brute_force(spark):
    rng, rows = random.Random(2), []
    for i in range(1, 3000):
        rows.append((i, None if i % 97 == 0 else "hot" if i % 3 == 0 else f"k{rng.randrange(900)}"))
    rows += [(None, "hot"), *rows[10:40], (5000, ""), (5001, ""), (5002, "x" * 100_000)]
    first = {}
    for i, k in rows:
        if i is not None and k is not None:
            first[k] = min(first.get(k, i), i)
    want = sorted({i for i, k in rows if i is not None and k is not None and i > first[k]})
    df = table(spark, rows, "offer_id long, k string")
    assert [r[0] for r in seen.seen_before(df, "offer_id", F.col("k"), block=64).orderBy("offer_id").collect()] == want
    # a filter so narrow that it is often wrong changes nothing after the exact check
    assert seen.seen_before(df, "offer_id", F.col("k"), width=10, block=64).count() == len(want)
    assert seen.seen_before(df.limit(0), "offer_id", F.col("k")).count() == 0


def test_what_the_filter_says_decides(spark, monkeypatch):
    # keys of many partitions whose repeats are all in later blocks
    rows = [(b * 100 + i, f"k{i}") for b in range(4) for i in range(100)]
    df = table(spark, rows, "offer_id long, k string").repartition(8)
    assert seen.seen_before(df, "offer_id", F.col("k"), block=100).count() == 300
    sound = seen._ask

    def blind(t):
        out = sound(t)
        return out.set_column(2, "seen", seen.pa.array([b"\0" * len(x.as_py()) for x in out.column("seen")], seen.pa.binary()))

    monkeypatch.setattr(seen, "_ask", blind)
    assert seen.seen_before(df, "offer_id", F.col("k"), block=100).count() < 50  # what is left stands in one block


def test_error_report_measures_what_it_derives(spark):
    df = spark.range(1, 20001).select(F.col("id").alias("offer_id"), F.concat(F.lit("key"), F.col("id")).alias("k"))
    rows = {r.bits: r for r in seen.error_report(df, "offer_id", F.col("k"), widths=(16, 18, 48)).collect()}
    assert rows[48].wrong == 0 and rows[48]["keys"] == 20000
    for bits in (16, 18):
        assert rows[bits].measured_rate == pytest.approx(rows[bits].derived_rate, rel=0.15)


def test_stored_filters_merge_and_are_asked(spark):
    old = spark.range(0, 1000).select(F.concat(F.lit("k"), F.col("id")).alias("k"))
    more = spark.range(900, 1500).select(F.concat(F.lit("k"), F.col("id")).alias("k"))
    both = seen.merge_filters(seen.build_filter(old, F.col("k"), 2).unionByName(seen.build_filter(more, F.col("k"), 2)))
    assert both.agg(F.sum("keys")).first()[0] == 1500
    asked = spark.range(1400, 1600).select("id", F.concat(F.lit("k"), F.col("id")).alias("k"))
    got = {r.id: r.maybe_seen for r in seen.probe_filter(asked, "id", F.col("k"), both, 2).collect()}
    assert got == {i: i < 1500 for i in range(1400, 1600)}


# --- repetition ---------------------------------------------------------------------------------
def repeated(text):
    w = WORD.findall((text or "").lower())
    known, mark = set(), [0] * len(w)
    for i in range(len(w) - 4):
        g = tuple(w[i:i + 5])
        if g in known:
            mark[i:i + 5] = [1] * 5
        known.add(g)
    return len(w), sum(mark)


def test_repetition_equals_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    texts = [None, "", "one two", "a b c d e", "a " * 60, "!? " * 80, "x y z " * 30, sentence(rng, 5000)]
    texts += [(sentence(rng, rng.randrange(5, 30)) + ". ") * rng.randrange(1, 4) + sentence(rng, rng.randrange(0, 80)) for _ in range(40)]
    rows = list(enumerate(texts)) + [(3, texts[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_words", F.lit(1)).withColumn("n_words", F.lit("x"))
    got = sorted((r.doc_id, r.n_words, r.repeated_words) for r in repetition.measure(df, "doc_id", "text").collect())
    assert got == sorted((i, *repeated(t)) for i, t in rows)
    want = sorted({i for i, t in rows if repeated(t)[0] >= 50 and repeated(t)[1] >= 0.3 * repeated(t)[0]})
    assert sorted(r.doc_id for r in repetition.repetitive(df, "doc_id", "text").collect()) == want and want
    monkeypatch.setattr(repetition, "POSITION_BITS", 3)  # every text counts as very long
    assert sorted(r.doc_id for r in repetition.repetitive(df, "doc_id", "text").collect()) == want
    assert repetition.measure(df.limit(0), "doc_id", "text").count() == 0


# --- leaks --------------------------------------------------------------------------------------
def brute_leaks(docs, items):
    out = set()
    for d, t in docs:
        w = WORD.findall((t or "").lower())
        for i, u in items:
            v = WORD.findall((u or "").lower())
            n = min(12, len(v))
            runs = {tuple(v[k:k + n]) for k in range(len(v) - n + 1)} if n else set()
            if d is not None and any(tuple(w[k:k + n]) in runs for k in range(len(w) - n + 1)):
                out.add((d, i))
    return out


@pytest.mark.parametrize("sent", [4_000_000, 1])
def test_leaks_equal_brute_force(spark, monkeypatch, sent):
    monkeypatch.setattr(leaks, "SENT_WORDS", sent)
    rng = random.Random(6)
    items = [(i, sentence(rng, rng.randrange(3, 40))) for i in range(20)] + [(90, None), (91, ""), (92, "--")]
    docs = [(0, None), (1, ""), (2, "!?")]
    for d in range(3, 60):
        words = sentence(rng, 60).split()
        v = rng.choice(items[:20])[1].split()
        k = rng.randrange(max(1, len(v) - 12))
        words[20:20] = v[k:k + rng.choice([6, 11, 12, 20])]
        docs.append((d, " ".join(words).title()))
    docs += [docs[9], (None, docs[9][1])]
    got = leaks.leaked(table(spark, docs, "doc_id long, text string"), table(spark, items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.where("exact").collect()} == brute_leaks(docs, items)
    assert leaks.leaked(table(spark, docs, "doc_id long, text string").limit(0), table(spark, items, "item_id long, text string")).count() == 0


@pytest.mark.parametrize("sent", [4_000_000, 1])
def test_reparameterised_items_are_told_from_chance(spark, monkeypatch, sent):
    monkeypatch.setattr(leaks, "SENT_WORDS", sent)
    item = [(1, "if 12 boats leave every 5 minutes how many leave in 12 hours at noon")]
    docs = [(1, "quiz: If 30 boats leave every 7 minutes how many leave in 30 hours at noon?"),
            (2, "quiz: If 30 boats leave every 7 minutes how many leave in 31 hours at noon?")]
    rows = leaks.leaked(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(item, "item_id long, text string")).collect()
    assert {(r.doc_id, r.exact) for r in rows if r.windows == 4} == {(1, False)}


def test_both_ways_of_finding_leaks_give_the_same_columns(spark, monkeypatch):
    rng = random.Random(11)
    items = [(i, f"when {rng.choice(['two', 'nine', '17'])} boats met {sentence(rng, 9)} for {i} euros and {rng.randrange(9)} days {sentence(rng, 4)}") for i in range(12)] + [(50, "one"), (51, "the door"), (52, items_twice := "old map of the hill")]
    docs = []
    for d in range(80):
        t = rng.choice(items)[1].split()
        t = [str(rng.randrange(99)) if w.isdigit() and rng.random() < 0.7 else w for w in t]
        docs.append((d, " ".join([*sentence(rng, 20).split(), *t, *sentence(rng, 5).split(), *rng.choice([items_twice, "the door"]).split()])))
    df, it = table(spark, docs, "doc_id long, text string"), table(spark, items, "item_id long, text string")
    plain = sorted(tuple(r) for r in leaks.leaked(df, it).collect())
    monkeypatch.setattr(leaks, "SENT_WORDS", 1)
    assert sorted(tuple(r) for r in leaks.leaked(df, it).collect()) == plain
    assert sum(not r[2] for r in plain) > 5 and sum(r[2] for r in plain) > 80


@pytest.mark.parametrize("sent", [4_000_000, 1])
def test_a_slot_that_is_kept_and_changed_is_no_item(spark, monkeypatch, sent):
    monkeypatch.setattr(leaks, "SENT_WORDS", sent)
    item = spark.createDataFrame([(1, "if 5 boats leave every 5 minutes how many leave by noon")], "item_id long, text string")
    docs = [(1, "If 5 boats leave every 7 minutes how many leave by noon?"), (2, "If 7 boats leave every 7 minutes how many leave by noon?")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert [r.doc_id for r in leaks.leaked(df, item).collect()] == [2]
    monkeypatch.setattr(leaks, "MOST_NAMES", 1)
    with pytest.raises(ValueError):
        leaks.leaked(df, item, spark.createDataFrame([("Otis",), ("Viola",)], "given_name string"))


# --- mixtures -----------------------------------------------------------------------------------
def test_plan_meets_shares_and_caps():
    capacity = {("a",): 1000, ("a", "b"): 200, ("b",): 50, ("c",): 10}
    targets = {"a": (0.5, 1), "b": (0.4, 2), "c": (0.1, 4)}
    total, segments = mixing.plan(capacity, targets)
    assert 400 <= total < 410  # c has 40 tokens at most, a tenth; quotas are whole tokens
    got = {}
    for pattern, own in segments.items():
        for layer, lo, hi, s in own:
            assert s in pattern and layer < min(targets[x][1] for x in pattern) and 0 <= lo < hi <= capacity[pattern]
            got[s] = got.get(s, 0) + hi - lo
    assert got == {s: int(share * total) for s, (share, _) in targets.items()}
    assert all(layer == 0 for layer, *_ in segments["a", "b"])  # no repetition where there is enough without
    assert mixing.plan({}, targets)[0] == 0


def test_mixture_of_documents(spark):
    rng, rows = random.Random(8), []
    for i in range(900):
        rows.append((i, sentence(rng, rng.randrange(5, 40)), rng.choice(["big"] * 8 + [" BIG ", "small", "Mid", None, "other"])))
    rows += [(900 + i, "the same copy in every source", s) for i, s in enumerate(["big", "mid", "small"] * 20)] + [(2000, None, "big"), (2001, "", "mid"), (None, "x", "mid")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).withColumn("tokens", F.lit(1)).withColumn("pattern", F.lit(1))
    goals = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.2, 3)], "source string, target_share double, max_repeats int")
    out = mixing.mix(df, goals).collect()
    assert out == mixing.mix(df.repartition(7), goals).orderBy(F.lit(1)).collect() or sorted(out) == sorted(mixing.mix(df.repartition(7), goals).collect())
    cap = {"big": 1, "mid": 2, "small": 3}
    assert all(1 <= r.repeats <= cap[r.source] for r in out)
    size = sum(r.tokens * r.repeats for r in out)
    for s, share in (("big", 0.5), ("mid", 0.3), ("small", 0.2)):
        assert sum(r.tokens * r.repeats for r in out if r.source == s) / size == pytest.approx(share, abs=0.01)
    by_doc = dict((r[0], r[1]) for r in rows)
    assert sum(r.repeats for r in out if by_doc[r.doc_id] == "the same copy in every source") <= 1
    report = {r.source: r for r in mixing.shares(mixing.mix(df, goals), goals).collect()}
    assert report["mid"].most_repeats <= 2
    assert mixing.mix(df.limit(0), goals).count() == 0 and mixing.mix(df, goals.limit(0)).count() == 0


# --- quality ------------------------------------------------------------------------------------
PROSE = ["The crew must clean one damp form and visit your layout before the fair, because nobody wanted to see it at all.",
         "not - even - every - summer footer nearly had to sort their\n- compact summer banner when nobody fixed the generous menu and\n- the central menu became dusty",
         "Die leere Suche braucht das warme Formular, weil das kleine Brot die lange Kiste findet und der Weg nicht hält.",
         "La cuisine sombre porte la cuisine rouge, pendant que la haie calme charge la boussole moderne de la page."]
OTHER = ["- tidy favicon\n- broken header\n- broken font\n- tidy template\n- yellow selector\n- borrowed sidebar\n- damp tooltip\n- handmade footer",
         "/* TEAM */\nCode: a verbose iframe\nTools: the modal\nChef: an odd sprite\nWords: their cookie\nFrom: Conrad Haskides\nLanguage: the menu",
         "Form,Login,Tooltip\ncheckout,57.37,61.13\n9268,no,61.43\n68.11,sprite,2022-01\nmodal,yes,redirect\nplugin,ok,5.25",
         "a.t2(f,21);if(!wz[6]){i=exl}y.h8(x,7);if(!4n[3]){x=jco}l.i9(d,52);if(!5q[7]){j=kjc}",
         "cheap old dock buy summer kiosk online painted mast cheap reliable deck near me blue lantern online shallow anchor"]


def test_prose_is_told_from_other_forms(spark):
    rows = list(enumerate(PROSE + OTHER)) + [(50, None), (51, ""), (52, "\n\n"), (53, "short words"), (54, "word " * 50_000), (0, PROSE[0])]
    df = table(spark, rows, "find_id long, text string")
    got = quality.statistics(df).collect()
    assert len(got) == len(rows)
    prose = {r.find_id: r.prose for r in got}
    assert all(prose[i] for i in range(len(PROSE))) and not any(prose[len(PROSE) + i] for i in range(len(OTHER)))
    zero = next(r for r in got if r.find_id == 50)
    assert zero.n_words == 0 and zero.mean_word_length == 0 and not zero.prose
    words = {r.find_id: r.n_words for r in got}
    assert all(words[i] == len(WORD.findall((t or "").lower())) for i, t in rows)
    found = {r.find_id for r in quality.not_prose(df).collect()}
    assert found == {len(PROSE) + i for i in range(len(OTHER))} | {54}
    assert quality.statistics(df.limit(0)).count() == 0


def test_a_model_is_fitted_on_labels_and_layout_takes_part(spark):
    rng = random.Random(12)
    rows, labels = [], []
    for i in range(120):
        if i % 4 == 3:
            text = "\n".join(f"- {rng.choice(['tidy', 'loose', 'very plain'])} {rng.choice(['lamp', 'boat'])}" for _ in range(8))
        elif i % 2:
            text = "\n".join(f"{rng.choice(['ab', 'cd', 'ef'])}{k} | {rng.randrange(100, 999)} | {rng.choice(['on', 'no'])}" for k in range(8))
        else:
            text = f"The {rng.choice(['old', 'red'])} door of the mill was {rng.choice(['open', 'shut'])}, because {sentence(rng, 4)} and nobody had seen it at all."
        rows.append((i, text))
        labels.append((i, "table" if i % 2 else " Prose "))
    df, known = table(spark, rows, "find_id long, text string"), spark.createDataFrame([*labels, (None, "prose"), (900, "prose"), (3, None)], "find_id long, form string")
    model = quality.fitted(df, known)
    assert model.held > 30 and model.wrong == 0
    assert {r.find_id for r in quality.not_prose(df, model=model).collect()} == {i for i in range(120) if i % 2}
    kept = quality.statistics(df, model=model).collect()
    x = np.array([[r.loose_words / r.n_words, r.loose_words * 2 > r.n_words, *(r[f] for f in quality.FEATURES[2:])] for r in kept], float)
    assert ((model.score(x) > 0) == [r.prose for r in kept]).all()
    for k in (2, 3, 4):  # each measure of layout moves the verdict
        assert abs(model.weights[k]) > 0 and not np.allclose(model.score(x), model.score(np.where(np.arange(x.shape[1]) == k, model.mean, x)))
    assert quality.fitted(df, known.limit(0)) is None and quality.fitted(df.limit(0), known) is None


def test_indented_lists_are_no_prose():
    import pyarrow as pa

    listed = "What is in it\n    the lamp of the hill\n    the door to the mill\n        a map of it\n        all of the keys\n    the cat and the hat\n    a boat for two"
    wrapped = "Notes\n    The crew must clean one damp form and visit your\n    layout before the fair, because nobody wanted to see\n    it at all. Then they went home with the lamp and\n    the map"
    m = quality.measure(pa.array([listed, wrapped]))
    assert m["loose_words"][0] * 2 > m["n_words"][0] and m["loose_words"][1] == 0 and m["periodicity"][0] > 0.5


# --- personal details ---------------------------------------------------------------------------
TEXT = ("Contact Viola T. Stavford-Ostby <viola@post.mill.example> or +49 (0)30 23125 304 about it. Ticket 618-7307, part X375-019429.\n"
        "Passport no.: X0L487864; write to ask at mill dot test. Our office (740 W. Oak Drive, Suite 23, Lowtown, ZZ 00898) is open. The Iris Trail stays. "
        "Imprint: Osierstr. 117, 00437 Moor. See logo@3x.png. Thanks to Wrenby, Linnea for the banner container.")
FOUND = {("person", "Viola T. Stavford-Ostby"), ("email", "viola@post.mill.example"), ("phone", "+49 (0)30 23125 304"), ("id_number", "X0L487864"), ("email", "ask at mill dot test"),
         ("address", "740 W. Oak Drive, Suite 23, Lowtown, ZZ 00898"), ("address", "Osierstr. 117, 00437 Moor"), ("person", "Wrenby, Linnea")}


def test_details_are_found_and_replaced(spark):
    rows = [(1, TEXT), (2, None), (3, ""), (4, TEXT + " " + TEXT), (5, "no details here, only the owner of a banner"), (6, "z" * 200_000)]
    df = table(spark, rows, "find_id long, text string")
    names = spark.createDataFrame([("Viola",), ("Linnea",), ("Iris",), (None,)], "given_name string")
    got = pii.details(df, names).collect()
    assert {(r.pii_type, r.found) for r in got if r.find_id == 1} == FOUND == {(r.pii_type, r.found) for r in got if r.find_id == 4}
    assert len(got) == 2 * len(FOUND)
    out = {r.find_id: r for r in pii.redacted(df, names).collect()}
    assert out[2].text is None and out[3].text == "" and out[1].details == len(FOUND) and out[4].details == 2 * len(FOUND)
    assert not any(f in out[1].text for _, f in FOUND) and out[1].text.startswith("Contact [PERSON] <[EMAIL]> or [PHONE] about it.")
    assert pii.details(df.limit(0), names).count() == 0


def test_family_names_of_any_ending_are_found_after_listed_names():
    names = frozenset(("anna", "maria", "john", "iris", "otis", "viola"))
    text = ("Anna Weber met Maria Rossi, John A. Smith's aunt, and Otis de la Cruz; Viola O'Brien-Hale and Anna Maria Keller came.\nBy: Weber, Anna\nJOHN SMITH wrote.\n"
            "The Iris Trail stays, Iris Gallery too. Code: Otis\nTools: none. Yesterday, Anna left. Viola Was here. IRIS CONTACT FORM. anna weber")
    assert [text[a:b] for a, b, _ in pii.find(text, names)] == ["Anna Weber", "Maria Rossi", "John A. Smith", "Otis de la Cruz", "Viola O'Brien-Hale", "Anna Maria Keller", "Weber, Anna", "JOHN SMITH"]


def test_given_names_are_learned_from_the_texts(spark):
    families = ["Miller", "Garcia", "Schmidt", "Dupont", "Brown", "Nguyen"]
    rows = [(i, f"Thanks to Anna {f} for it.") for i, f in enumerate(families)]
    rows += [(20 + i, f"Later James {f} came, and so did Wei T. de la {f}.") for i, f in enumerate(families[:3])]
    rows += [(40, "James Okafor wrote. Contact James Miller. Hans Zimmer did not."), (41, "Blue Miller and Blue Harbour and Blue Lagoon and Blue Ridge and Blue Garcia"), (42, None), (43, "")]
    df = table(spark, rows, "find_id long, text string")
    names = spark.createDataFrame([("Anna",)], "given_name string")
    assert pii.learned(df, ("anna",)) == ("james", "wei")
    got = {(r.find_id, r.found) for r in pii.details(df, names).collect()}
    assert {f for i, f in got if i == 40} == {"James Okafor", "James Miller"} and (21, "Wei T. de la Garcia") in got and not {f for i, f in got if i == 41}
    assert pii.learned(df.limit(0), ("anna",)) == ()


def test_surrogates_keep_distinctness_and_coreference(spark):
    names = spark.createDataFrame([(n,) for n in ("Viola", "Linnea", "Otis", "Tobin")], "given_name string")
    rows = [(i, f"Call 020 7946 {i:04d} or 020-7946-{i:04d}, Otis Lovby.") for i in range(300)] + [(900, "OTIS LOVBY wrote."), (901, None)]
    out = pii.surrogates(table(spark, rows, "find_id long, text string"), b"k", names).collect()
    phones = [r for r in out if r.pii_type == "phone"]
    assert len({r.surrogate for r in phones}) == len(phones) == len({r.entity for r in phones}) >= 300
    assert all(len(r.surrogate) == len(r.entity) and r.surrogate.isdigit() for r in phones)
    assert len([r for r in out if r.pii_type == "person"]) == 1
    a = pii.surrogate("person", "Viola Ostby", b"k", ("Anna", "Otis", "Mia"))
    assert a == pii.surrogate("person", "Viola Ostby", b"k", ("Anna", "Otis", "Mia")) != pii.surrogate("person", "Viola Ostby", b"other", ("Anna", "Otis", "Mia"))
    assert a.split()[0] in ("Anna", "Mia") and pii.surrogate("person", "OSTBY, VIOLA", b"k", ("Anna", "Mia")).isupper()


def test_surrogates_are_put_into_the_texts(spark):
    a, b = "Call 020 7946 0001, ask", "or 020-7946-0001; OTIS T. van LOVBY. By Lovby, Otis"
    rows = [(1, f"{a} Otis T. van Lovby <otis@post.mill.example>."), (2, f"{b} otis [at] post [dot] mill [dot] example."), (3, None), (4, "nothing here")]
    names = spark.createDataFrame([(n,) for n in ("Otis", "Tobin", "Ulrik")], "given_name string")
    df = table(spark, rows, "find_id long, text string")
    out = {r.find_id: r for r in pii.replaced(df, b"k", names).collect()}
    assert out[3].text is None and out[4].text == "nothing here" and out[1].details == 3 and out[2].details == 4
    x, y = (re.fullmatch(p, out[k].text) for k, p in ((1, r"Call (\d{3} \d{4} \d{4}), ask (\w+ \w\. van \w+) <(\w+@\w+\.\w+\.example)>\."), (2, r"or (\d{3}-\d{4}-\d{4}); (\w+ \w\. van \w+)\. By (\w+, \w+) (\w+ \[at\] \w+ \[dot\] \w+ \[dot\] example)\.")))
    assert x[1].replace(" ", "") == y[1].replace("-", "") != "02079460001"
    assert y[2].replace("van", "VAN").isupper() and x[2].lower() == y[2].lower() and pii.norm("email", x[3]) == pii.norm("email", y[4])
    assert not any(w in (out[1].text + out[2].text).lower() for w in ("lovby", "mill", "otis@"))
    assert re.fullmatch("[А-я]+ [А-я]+", pii.surrogate("person", "Анна Петрова", b"k", ("anna",)))


# --- residue ------------------------------------------------------------------------------------
RESIDUE = ["Hello {{user_name}}, the widget is ready", "Dear undefined, thanks for it", "Welcome to [insert old dock], where", "Copyright %%YEAR_NOW%%, keeper", "Lorem ipsum dolor sit amet, quisque",
           "404 Not Found. The requested resource could not be located on this server.", "Error 500 - Internal Server Error", "Oops! That page doesn't exist.", "Dear [FIRST NAME], hi", "Hello {FIRST_NAME}, thanks", "{user_name} has left",
           "404\nNot Found\nnginx", "Page introuvable sur mill.example.", "Please enable\nJavaScript to see mill.test.", "noscript: content hidden", "Your subheading about the boat here"]
CLEAN = ["The {{ mustache }} braces in the door are meant to stay.", "If this returns undefined again I will bury it.", "Finally threw out the lorem ipsum near the door.", "Whoever typed 'your name here' into it owes me coffee.",
         "Our 404 page is drawn by hand.", "Works without JavaScript, the door insists on it.", "An error 500 once ate that map.", "Enable dark mode to see the door.", ":smile: [x] done", "Thanks to [the] old crew of the page, it can be found again.", "The door could not be found [again]. Write to hello [at] mill.test", "A long list of tame, live, done, note, same, fine, more and lorem"]


def test_residue_is_told_from_talk_about_it(spark):
    rows = [(i, t, "https://a.test/x", f"h{i}.test") for i, t in enumerate(RESIDUE + CLEAN)] + [(80, None, None, None), (81, "", None, None), (82, "a{b" * 90_000, None, "x.test"), (0, RESIDUE[0], None, None)]
    rows += [(100 + i, f"Strange answer {i}. Reload the page.", "https://a.test/some-door", f"host{i}.test") for i in range(4)] + [(200, "Only once: reload the page.", None, "one.test")]
    df = spark.createDataFrame(rows, "find_id long, text string, url string, domain string").withColumn("weak", F.lit(1)).withColumn("h", F.lit(1))
    got = {r.find_id for r in residue.judged(df).collect()}
    assert got == set(range(len(RESIDUE))) | {100, 101, 102, 103}
    kept = {r.find_id for r in residue.without_residue(df).collect()}
    assert kept == {r[0] for r in rows} - got
    assert residue.judged(df.limit(0)).count() == 0
    assert zlib.crc32(residue.NEAR.encode())  # the pattern compiles for the linear pass as a whole


def test_unlisted_messages_are_judged_by_hosts_and_addresses(spark):
    rows = [(i, f"Oops, something went wrong on our side ({i}).", f"https://a.test/blue-door-{i}", f"host{i}.test") for i in range(6)]
    rows += [(20 + i, "Hier ist leider gar nichts", "https://a.test/gate", f"host{i}.test") for i in range(6)]
    rows += [(40 + i, "The blue door of the mill", "https://a.test/blue-door", f"host{i}.test") for i in range(9)]  # what the address says
    rows += [(60 + i, "A line somebody copied here", "https://a.test/gate", f"host{i % 5}.test") for i in range(9)]  # too few hosts
    rows += [(80 + i, "Nothing tells what this is", "https://a.test/", f"host{i}.test") for i in range(9)]  # no words to compare with
    rows += [(100 + i, f"Odd answer, incident {i}00000{i}", "https://a.test/gate", f"host{i}.test") for i in range(3)]
    df = spark.createDataFrame(rows, "find_id long, text string, url string, domain string").repartition(3)
    assert sorted(r.find_id for r in residue.judged(df).collect()) == [*range(6), *range(20, 26), *range(100, 103)]
