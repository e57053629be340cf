"""Percentiles, canonical names, components, tokenizer, mixtures, toxicity."""

import base64
import math
import random

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from driftline.llm import bpe, mixing, toxicity
from driftline.llm.canonical import canonical, canonical_by_part, repaired
from driftline.llm.components import components, star_edges
from driftline.llm.percentiles import combine, keep, kept, percentiles, summarise


def rank_value(values, q):
    values = sorted(values)
    return values[max(1, -(-q * len(values) // 1000)) - 1]


def test_percentiles_of_groups_and_of_combined_parts(spark):
    rng, rows = random.Random(1), []
    for _ in range(3000):
        rows.append((rng.choice(["hot", "hot", "hot", "a", None]), rng.choice([None, float("nan"), round(rng.gauss(18, 2), 4), 18.5, 18.5]), 1, "x"))
    rows += [("one", 3.25, 1, "x"), ("inf", float("inf"), 1, "x"), ("inf", float("-inf"), 1, "x"), ("void", None, 1, "x")]
    df = spark.createDataFrame(rows, "g string, v double, n int, bin string")
    quantiles = [0, 10, 250, 500, 750, 999, 1000]
    want = {}
    for g, v, *_ in rows:
        if v is not None and not math.isnan(v):
            want.setdefault(g, []).append(v)
    want = {(g, q): (len(vs), rank_value(vs, q)) for g, vs in want.items() for q in quantiles}
    halves = df.randomSplit([0.5, 0.5], seed=3)
    for summary in (summarise(df, ["g"], "v"), combine([summarise(h, ["g"], "v") for h in halves], ["g"])):
        got = {(r.g, r.permille): (r.n_values, r.value) for r in percentiles(summary, ["g"], quantiles, partitions=5).collect()}
        assert got == want


def test_percentiles_state_their_error(spark):
    rng = random.Random(2)
    values = [rng.uniform(-50, 50) for _ in range(999)]
    df = spark.createDataFrame([(1, v) for v in values], "g int, v double")
    for r in percentiles(summarise(df, ["g"], "v", 10), ["g"], [500, 900], 10).collect():
        assert abs(r.value - rank_value(values, r.permille)) <= r.max_error + 1e-9 and r.max_error == 0.05
    assert percentiles(summarise(df.where("g = 2"), ["g"], "v"), ["g"], [500]).count() == 0


def test_huge_values_keep_their_stated_error_and_summaries_can_be_stored(spark, tmp_path):
    values = [1e16, 3.3e15, -1e16, 9e14 + 0.25, 1e300, float("inf"), -0.0, 0.00004, 123456789.12345]
    df = spark.createDataFrame([(1, v) for v in values], "g int, v double")
    for k in (0, 1, 1):
        keep(summarise(df.where(F.col("v") > 0 if k else F.col("v") <= 0), ["g"], "v"), str(tmp_path), str(k))
    got = percentiles(combine(kept(spark, str(tmp_path), ["0", "1"]), ["g"]), ["g"], [1, 250, 500, 600, 700, 900, 1000]).collect()
    assert len(got) == 7
    for r in got:
        want = rank_value(values, r.permille)
        assert r.n_values == len(values) and (r.value == want or abs(r.value - want) <= r.max_error + 1e-9)


CATALOGUE = [
    ("(1245)", "Ciandrixprael", "1997 TZ18", ["1987 XO70", None, "1997 TZ18"]),
    ("(12450)", None, "1997 TZ1", None),
    (None, "Bamilim", "2018 HO", []),
    ("(99)", "Balmviatfom", "2001 WU368", ["1980 LE20"]),
]
NAMES = {
    "1245": "1997 TZ18", "(1245)": "1997 TZ18", "0001245": "1997 TZ18", "#1245": "1997 TZ18", "No. 1245": "1997 TZ18", "1,245": "1997 TZ18", "1245.0": "1997 TZ18",
    "1245 Ciandrixprael": "1997 TZ18", "(1245) Ciandrxprael": "1997 TZ18", "CIANDRIXPRAEL": "1997 TZ18", " ciandrixpreal ": "1997 TZ18", "Ciandríxprael": "1997 TZ18",
    "12450": "1997 TZ1", "1997TZ1": "1997 TZ1", "1997 tz18": "1997 TZ18", "1997-tz018": "1997 TZ18", "1997_TZ_18": "1997 TZ18", "1987 XO70": "1997 TZ18",
    "2O18HO": "2018 HO", "Bamillim": "2018 HO", "K01Wa8U": "2001 WU368", "198OLE20": "2001 WU368", "Balm viatfom": "2001 WU368",
    "1246": "UNMATCHED", "1997 TZ19": "UNMATCHED", "P/1997 T1": "UNMATCHED", "": "UNMATCHED", "  ": "UNMATCHED", "nan": "UNMATCHED", "test 1245": "UNMATCHED",
    "0": "UNMATCHED", "Completelyother": "UNMATCHED", "-": "UNMATCHED", "cand_1245": "UNMATCHED", "x" * 5000: "UNMATCHED",
}


def test_names_are_mapped_or_reported(spark):
    cat = spark.createDataFrame(CATALOGUE, "number string, name string, principal_desig string, other_desigs array<string>")
    rows = [(v, m, "t", "r") for v in NAMES for m in (1, 1, 2)] + [(None, 1, "t", "r")]
    df = spark.createDataFrame(rows, "ssnamenr string, obs_month int, token string, entry string")
    got = canonical_by_part(df, "ssnamenr", "obs_month", cat, "principal_desig", "number", "name", "other_desigs").collect()
    assert len(got) == 2 * len(NAMES)
    assert {r.ssnamenr: r.principal_desig for r in got} == NAMES
    none = canonical(df, "ssnamenr", cat.limit(0), "principal_desig", "number", "name", "other_desigs").collect()
    assert {r.entry for r in none} == {"UNMATCHED"} and len(none) == len(NAMES)
    assert canonical(df.limit(0), "ssnamenr", cat, "principal_desig", "number", "name", "other_desigs").count() == 0


def test_repaired_tokens_count_once(spark):
    cat = spark.createDataFrame([*CATALOGUE, (None, "Fentor", "2003 QK7", None)], "number string, name string, principal_desig string, other_desigs array<string>")
    names = {"Fentor": "2003 QK7", "Fentr": "2003 QK7", "7777 Fentor": "2003 QK7", "7777 Fentr": "UNMATCHED", "7777 Fentxor": "2003 QK7", "Ciandrxprael": "1997 TZ18", "7777 Ciandrxprael": "1997 TZ18"}
    df = spark.createDataFrame([(n,) for n in names], "ssnamenr string")
    got = {r.value: r for r in canonical(df, "ssnamenr", cat, "principal_desig", "number", "name", "other_desigs").collect()}
    assert {v: r.entry for v, r in got.items()} == names
    assert all(r.score is None or r.score <= 1 for r in got.values())
    assert got["Fentr"].score == pytest.approx(5 / 6) and got["7777 Fentxor"].score == pytest.approx(6 / 7 * 2**-0.5)


def test_scores_are_cosines(spark):
    cat = [(None, "Alexandria", "2003 QK7", None), (None, "Maria Maris", "2004 AB1", None), ("(5)", "Longerlettersinthisnameherethananyother", "2005 CD2", None)]
    cat = spark.createDataFrame(cat, "number string, name string, principal_desig string, other_desigs array<string>")
    names = {
        "Alexandrina Qqqqqqqqqq Zzzzzz Wwwwwwww": "UNMATCHED", "Alexandria Qqqqqqqqqq Zzzzzz Wwwwwwww": "UNMATCHED", "Alexandrina": "2003 QK7",
        "Maria Mariz Marix Maria": "2004 AB1", "Longerlettersinthisnameherethananyother": "2005 CD2", "ongerlettersinthisnameherethananyother": "2005 CD2",
        "Longerlettersinthisnameherethananyothexyr": "2005 CD2", "Longerlettersinhisnameherethananyothr": "2005 CD2", "Longerletersinhisnameherethananyothr": "UNMATCHED",
        "Longer letters in this name here than any other": "2005 CD2", "x" * 20_000: "UNMATCHED",
    }
    df = spark.createDataFrame([(n,) for n in names], "ssnamenr string")
    got = {r.value: r for r in canonical(df, "ssnamenr", cat, "principal_desig", "number", "name", "other_desigs").collect()}
    assert {v: r.entry for v, r in got.items()} == names
    assert all(r.score is None or r.score <= 1 for r in got.values())


def test_repair_finds_all_that_edit_distance_finds(spark):
    rng = random.Random(11)
    terms = {"w:" + "".join(rng.choice("abc") for _ in range(rng.choice([1, 3, 5, 8, 9, 12, 23, 24, 25, 26, 33, 48]))) for _ in range(120)}
    tokens = set(rng.sample(sorted(terms), 10))
    for term in terms:
        for slips in (1, 2, 3):
            word = list(term[2:])
            for _ in range(slips):
                at = rng.randrange(len(word) + 1)
                word[at : at + rng.choice([0, 1, 1])] = rng.choice(["", "a", "c", "b"])
            tokens.add("w:" + "".join(word))
    frame = lambda rows, name: spark.createDataFrame([(r,) for r in sorted(rows)], f"{name} string")
    got = {(r.token, r.term) for r in repaired(frame(tokens, "token"), frame(terms, "term")).collect()}
    want = {(t, t) for t in tokens & terms}
    for token in tokens - terms:
        near = {}
        for term in terms:
            a, b = len(token) - 2, len(term) - 2
            allowed = 2 if max(a, b) >= 8 else 1 if min(a, b) >= 4 else 0
            if (d := edit_distance(token, term)) <= allowed:
                near.setdefault(d, set()).add((token, term))
        want |= near[min(near)] if near else set()
    assert got == want and len(want) > 100


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j] + 1, row[j + 1] + 1, last + (x != y))
    return row[-1]


def union_find(edges):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return {x: root(x) for x in up}


@pytest.mark.parametrize("shape", ["path", "shuffled path", "star", "random", "mixed", "empty"])
def test_components(spark, shape):
    rng = random.Random(5)
    path = [(k, k + 1) for k in range(700)]
    ids = rng.sample(range(10**18, 10**18 + 10**6), 701)
    edges = {
        "path": path,
        "shuffled path": [(ids[a], ids[b]) for a, b in path],
        "star": [(10**9, k) for k in range(500)],
        "random": [(rng.randrange(400), rng.randrange(400)) for _ in range(250)],
        "mixed": [(1, 1), (None, 2), (3, None), (5, 4), (4, 5), (4, 5), (6, 4), (9, 8)] + [(-k, -k - 1) for k in range(1, 40)],
        "empty": [],
    }[shape]
    df = spark.createDataFrame(edges, "u long, v long")
    for sizes in ({}, {"hub_least": 20}):
        got = {r.item: r.group_id for r in components(df, **sizes).collect()}
        assert got == union_find(edges)
        if shape not in ("star", "random", "path"):
            break


def test_star_edges_tie_each_group(spark):
    rng = random.Random(6)
    rows = [(1, rng.randrange(10**6)) for _ in range(500)] + [(rng.randrange(2, 60), rng.randrange(10**6)) for _ in range(200)]
    df = spark.createDataFrame(rows, "g long, c long")
    edges = [(r.u, r.v) for r in star_edges(df, "g", "c", salts=8).collect()]
    first = {}
    want = union_find([(first.setdefault(g, c), c) for g, c in rows])
    assert union_find(edges) == want and len(edges) < 2 * len(set(rows))


def reference_encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.vocabulary(), "rb"))}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = ["", " ", "The quarry was visited.\r\n\tNext  line\n\n ", "<|endoftext|> is text", "Straße, naïve café, 北京市, 🙂🙂", "a" * 3000, "-=" * 2000, " ​ x", "'s 'll don't I'VE", "0123456789" * 50, " ".join("ab" * k for k in (23, 24, 25, 300))]


def test_encoding_equals_a_public_library(spark):
    want, own = reference_encoding(), bpe.encoder(bpe.vocabulary())
    for text in TEXTS:
        assert own.encode(text) == want.encode_ordinary(text)
    rows = [(k, t) for k, t in enumerate([*TEXTS, None])] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("doc_id", "ids")
    got = bpe.encode(df.withColumnRenamed("ids", "doc_id"), "doc_id", "text")
    for r in got.collect():
        text = [*TEXTS, None][r.doc_id]
        assert list(r.ids) == (want.encode_ordinary(text) if text else [])
    counts = {r.doc_id: r.n_tokens for r in bpe.count_tokens(df.withColumnRenamed("ids", "doc_id"), ["doc_id"], "text").collect()}
    assert counts == {k: len(want.encode_ordinary(t)) if t else 0 for k, t in rows}


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_encoding_of_any_text(text):
    own = bpe.encoder(bpe.vocabulary())
    assert own.encode(text) == reference().encode_ordinary(text)


_kept = []


def reference():
    if not _kept:
        _kept.append(reference_encoding())
    return _kept[0]


def test_rank_queue_gives_lowest_rank_leftmost_first():
    rng, queue, waiting = random.Random(7), bpe.RankQueue(50_257), []
    for _ in range(3000):
        if waiting and rng.random() < 0.5:
            waiting.sort()
            assert queue.pop() == waiting.pop(0)
        else:
            entry = (rng.choice([0, 63, 64, 4095, 4096, rng.randrange(50_257)]), rng.randrange(100))
            waiting.append(entry)
            queue.push(*entry)


def test_poisson_rates_have_their_means():
    for cap in (1, 2, 4):
        for mean in (0.01, 0.5, 0.9 * cap):
            assert mixing.capped_mean(mixing.rate_of_mean(mean, cap), cap) == pytest.approx(mean, rel=1e-6)
        assert mixing.poisson_steps(mixing.rate_of_mean(cap, cap), cap) == [0.0] * cap


def test_mixture_reaches_its_shares(spark):
    rng = random.Random(8)
    rows = [(k, "big" if k % 3 else "small", "word " * rng.randrange(1, 60), 1) for k in range(900)]
    rows += [(k, "other", "x", 1) for k in range(900, 950)] + [(951, None, "x y z", 1), (952, "small", None, 1), (953, "small", "", 1), (None, "big", "a b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, copy_no int")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.4, 2), ("absent", 0.1, 3)], "source string, target_share double, max_repeats int")
    mixed, shares = mixing.mixture(docs, "doc_id", "source", "text", targets)
    out, share = mixed.collect(), {r.source: r for r in shares.collect()}
    assert share["big"].actual_share == pytest.approx(5 / 9, abs=0.01) and share["small"].actual_share == pytest.approx(4 / 9, abs=0.01)
    assert share["absent"].actual_share == 0 and share["absent"].tokens_available == 0
    per = {}
    for r in out:
        per[r.doc_id] = max(per.get(r.doc_id, 0), r.copy_no)
    by = {r[0]: r[1] for r in rows}
    assert {by[d] for d in per} == {"big", "small"}
    assert all(n <= {"big": 1, "small": 2}[by[d]] for d, n in per.items())
    own = bpe.encoder(bpe.vocabulary())
    used = {s: sum(own.count(r.text) for r in out if r.source == s) for s in ("big", "small")}
    assert used == {s: share[s].tokens_used for s in used}
    again = mixing.mixture(docs.repartition(7), "doc_id", "source", "text", targets)[0].collect()
    assert [(r.doc_id, r.copy_no) for r in again] == [(r.doc_id, r.copy_no) for r in out]
    capped = spark.createDataFrame([("big", 0.5, 0), ("small", 0.4, None)], "source string, target_share double, max_repeats int")
    share = {r.source: r.actual_share for r in mixing.mixture(docs, "doc_id", "source", "text", capped)[1].collect()}
    assert share == {"big": 0, "small": 1}
    none, empty = mixing.mixture(docs.limit(0), "doc_id", "source", "text", targets)
    assert none.count() == 0 and {r.actual_share for r in empty.collect()} == {0.0}


def labelled(n, seed):
    rng = random.Random(seed)
    calm = "the council opened a new bridge near town and many people came to see it on monday morning before noon".split()
    bad = ["shut up you st*pid m0r0n", "you are a f i l t h y rat", "go to hell you ugly swiiiine"]
    rows = []
    for k in range(n):
        words = [rng.choice(calm) for _ in range(rng.randrange(30, 120))]
        toxic = k % 4 == 0
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((k, " ".join(words), int(toxic)))
    return rows


def test_toxicity_on_held_out_texts(spark):
    rows = labelled(400, 1)
    docs = spark.createDataFrame([(k, t, "s", 0.5) for k, t, _ in rows], "doc_id long, text string, source string, score double")
    labels = spark.createDataFrame([(k, y if k % 20 else 1 - y) for k, _, y in rows if k < 300] + [(7, None), (None, 1), (10**6, 1)], "doc_id long, toxic int")
    model, cut = toxicity.fit(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs.select("doc_id", "text"), ["doc_id"], "text", model).collect()}
    held = [(got[k] >= cut, bool(y)) for k, _, y in rows if k >= 300]
    assert np.mean([a == b for a, b in held]) >= 0.9
    odd = spark.createDataFrame([(1, None), (2, ""), (3, " \n "), (4, "you filthy rat " * 20_000)], "doc_id long, text string")
    odds = {r.doc_id: r.score for r in toxicity.score(odd, ["doc_id"], "text", model).collect()}
    assert odds[1] == odds[2] == odds[3] == 0 and 0 <= odds[4] <= 1
    model, cut = toxicity.fit(docs, labels.where("toxic = 5"))
    assert cut > 1


def test_gradient_of_the_network():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in toxicity.initial(1).items()}
    n = toxicity.HALO + toxicity.WINDOW
    af, ab = (rng.normal(size=(n, 3, 3 * toxicity.HIDDEN)) for _ in range(2))
    real = np.ones((n + toxicity.HALO, 3), bool)
    real[19:, 1] = False
    real[: toxicity.HALO, 2] = False
    weight = rng.normal(size=3)

    def loss():
        return float(toxicity._forward(p, af, ab, real)[0] @ weight)

    grads, daf, dab = toxicity._back(p, weight, toxicity._forward(p, af, ab, real)[1])
    for array, grad in ((p["uf"], grads["uf"]), (p["ub"], grads["ub"]), (p["aw"], grads["aw"]), (p["ow"], grads["ow"]), (af, daf), (ab, dab)):
        at = tuple(rng.integers(0, s) for s in array.shape)
        kept, step = array[at], 1e-3
        array[at] = kept + step
        up = loss()
        array[at] = kept - step
        down = loss()
        array[at] = kept
        assert (up - down) / (2 * step) == pytest.approx(grad[at], rel=2e-2, abs=2e-3)


def test_words_in_one_spelling():
    assert toxicity.tokens("b r a i n l e s s m0r0n") == ["brainless", "m0r0n"]
    assert toxicity.tokens("sch-\nöne Bäc­\nker") == ["schöne", "Bäcker"]
    assert toxicity.normal("M1ST-K3RL!") == "mistkerl" and toxicity.normal("d@mn,ed") == "damned" and toxicity.normal("1,234.") == "0" and toxicity.normal("s******r") == "s*r" and toxicity.normal("stuppppid") == "stupid"


def test_long_words_are_read_to_their_last_letter():
    word = "".join(chr(97 + (k * 7 + k // 9) % 26) for k in range(60))
    pieces = toxicity.tokens(f"a {word}. b")
    assert pieces[0] == "a" and pieces[-1] == "b" and all(len(w) <= toxicity.LETTERS for w in pieces)
    grams = {w[k : k + 3] for w in pieces for k in range(len(w) - 2)}
    assert {word[k : k + 3] for k in range(58)} <= grams
    scorer = toxicity.Scorer(toxicity.initial(3))
    same = "x" + "yz" * 30
    assert scorer.score([same + "abc"])[0] != scorer.score([same + "cba"])[0]
    assert toxicity.features(["a" * 18])[1].any() and len(toxicity.tokens("z1" * 50_000)) > 1000


def test_windows_start_at_every_word():
    for n in (1, 5, 24, 25, 40, 41, 333):
        for stride in (1, 8):
            first, doc = toxicity.starts(np.array([3, 0, n]), stride)
            mine = first[doc == 2] - 3
            assert (doc == 0).sum() == 1 and not (doc == 1).any() and mine[-1] == max(0, n - toxicity.WINDOW)
            assert set(mine) == {*range(0, max(1, n - toxicity.WINDOW + 1), stride), max(0, n - toxicity.WINDOW)}


def brute_states(scorer, places, gates, proj):
    h, out = np.zeros(toxicity.HIDDEN), []
    for w in places:
        z, g = (1 / (1 + np.exp(-(proj[k][w] + h @ gates[k].astype(float)))) for k in (0, 1))
        new = np.tanh(proj[2][w] + g * (h @ gates[2].astype(float)))
        h = new + z * (h - new)
        out.append(h)
    return np.array(out)


@pytest.mark.parametrize("lengths", [[1], [5, 0, 30], [24, 25], [200, 3, 90]])
def test_score_is_that_of_the_best_of_all_windows(lengths):
    rng, p = np.random.default_rng(4), toxicity.initial(3)
    p = {k: v * 6 if k in ("word", "gram") else v for k, v in p.items()}
    scorer, texts = toxicity.Scorer(p), [[f"w{rng.integers(90)}" for _ in range(n)] for n in lengths]
    got = scorer.score([" ".join(t) for t in texts])
    for text, score in zip(texts, got):
        if not text:
            assert score == 0
            continue
        places, size, e, s = [scorer.place[w] for w in text], toxicity.SEGMENT, [], []
        for start in range(0, len(text), size):
            low, high = max(0, start - toxicity.HALO), min(len(text), start + size + toxicity.HALO)
            end = min(len(text), start + size)
            hf = brute_states(scorer, places[low:end], scorer.gates[0], scorer.proj[:3])[start - low :]
            hb = brute_states(scorer, places[start:high][::-1], scorer.gates[1], scorer.proj[3:])[::-1][: end - start]
            h = np.concatenate([hf, hb], axis=1)
            e.extend(np.exp(np.tanh(h @ p["aw"] + p["ab"]) @ p["av"]))
            s.extend(h @ p["ow"])
        e, s, w = np.array(e), np.array(s), toxicity.WINDOW
        each = [(e[k : k + w] * s[k : k + w]).sum() / e[k : k + w].sum() + p["ob"][0] for k in range(max(1, len(text) - w + 1))]
        assert score == pytest.approx(1 / (1 + np.exp(-max(each))), abs=1e-5)


def test_window_of_the_fit_is_that_of_the_scorer():
    p = toxicity.initial(3)
    words = [f"w{k}" for k in range(20)]
    scorer = toxicity.Scorer(p)
    wid, gid = toxicity.features([toxicity.normal(w) for w in words])
    x = p["word"][wid] + p["gram"][gid].sum(axis=1)
    at, real = toxicity.around(np.array([0]), np.array([0]), np.array([20]), toxicity.HALO, toxicity.WINDOW + toxicity.HALO)
    n = toxicity.HALO + toxicity.WINDOW
    logit = toxicity._forward(p, (x @ p["xf"] + p["bf"])[at.T[:n]], (x @ p["xb"] + p["bb"])[at.T[-n:]], real.T)[0]
    assert scorer.logits(*scorer.places([words]))[0] == pytest.approx(logit[0], abs=1e-5)


def test_fit_does_not_depend_on_partitions(spark):
    rows = labelled(120, 2)
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int")
    sizes = {"rounds": 2, "steps": 5, "shard_docs": 40}
    one = toxicity.fit(docs, labels, **sizes)
    two = toxicity.fit(docs.orderBy(F.desc("doc_id")).repartition(7), labels.repartition(3), **sizes)
    assert one == two
