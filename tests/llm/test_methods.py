"""Each method against brute force on small tables."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spindrift.llm import langid, line_dedup, lm_scoring, mixing, near_dedup, packing, pieces, textkernel, token_counts, toxicity, vector_dedup, vector_search
from spindrift.llm.attention import CONTEXT, STRIDE, WINDOW, Attention
from spindrift.llm.common import table


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=30), min_size=1, max_size=5))
def test_words(parts):
    raw = [p.encode("utf-8", "replace") for p in parts]
    offsets = np.cumsum([0, *map(len, raw)])
    rows, starts, ends, _ = textkernel.words(np.frombuffer(b"".join(raw), np.uint8), offsets)
    got = [(r, b"".join(raw)[a:b]) for r, a, b in zip(rows, starts, ends)]
    assert got == [(i, w) for i, x in enumerate(raw) for w in x.split()]


def brute_segmentation(word, logp, byte_logp):
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        width = len(word[end - 1].encode())
        found = [(best[end - 1][0] + width * byte_logp, -(-best[end - 1][1] + width))]
        found += [(best[a][0] + logp[word[a:end]], -(-best[a][1] + 1)) for a in range(end) if word[a:end] in logp]
        best.append(max(found))
    return -best[-1][1], best[-1][0]


def test_token_counts_match_plain_dynamic_programming(texts):
    path = pieces.pieces_path()
    logp, byte_logp = pieces.zipf_scores(path)
    trie, small = token_counts.PrefixTrie(path), token_counts.PrefixTrie(path, most_nodes=50)
    cases = [" ".join(text.split()[:200]) for text in list(texts.values())[:5]] + ["x" * 300 + " " + "aé日" * 70 + "\u00a0b"]
    for text in cases:
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        expected = [brute_segmentation("▁" + w, logp, byte_logp) for w in words]
        for t in (trie, small):
            n_words, n_tokens, score = t.totals(text)
            assert (n_words, n_tokens) == (len(words), sum(n for n, _ in expected)) and math.isclose(score, sum(x for _, x in expected))


def test_forward_sums_all_segmentations():
    model = object.__new__(langid.Languages)
    model.names, model.pieces = ["x"], {"▁": [0.1], "▁a": [0.2], "a": [0.3], "b": [0.25], "ab": [0.05], "▁ab": [0.02]}
    p = {k: v[0] for k, v in model.pieces.items()}

    def total(s):
        return 1.0 if not s else sum(p[s[:k]] * total(s[k:]) for k in range(1, len(s) + 1) if s[:k] in p)

    held = langid.Marginal(model)
    for word in ("ab", "abab", "ba"):
        assert math.isclose(held.logs(word)[0], math.log(total("▁" + word)))
    assert math.isclose(held.logs("ab" * 4000)[0], 4000 * (held.logs("ab" * 400)[0] - held.logs("ab" * 399)[0]), rel_tol=1e-2)


def test_language_held_out(spark, sf_dir):
    docs = table(spark, "/root/testdata/sf0.01", "documents").withColumn("held", langid.held_out())
    got = langid.identify(docs, langid.learn(docs.where("not held")), ("doc_id", "lang", "held")).where("held").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.97


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    model = toxicity.learn(docs, labels.where(~toxicity.held_out()))
    got = toxicity.score(docs.join(labels.where(toxicity.held_out()), "doc_id"), model, ("doc_id", "toxic")).collect()
    hit = sum(r.toxic == (r.score >= 0.5) for r in got) / len(got)
    assert hit > 0.95 and sum(r.score >= 0.5 for r in got if r.toxic) > 0.7 * sum(r.toxic for r in got)


def test_composition_is_one_transducer_after_the_other():
    parts = [toxicity.insults(), toxicity.threats(), toxicity.targets(), toxicity.negations(), toxicity.reports()]
    whole, rng = toxicity.grammar(), np.random.default_rng(4)
    alphabet = [toxicity.OTHER, toxicity.TARGET, toxicity.NEGATION, toxicity.REPORT, toxicity.INTENT, *toxicity.HITS]
    for _ in range(200):
        state, states = 0, [0] * len(parts)
        for symbol in rng.choice(alphabet, 8):
            state, out, weight = whole.step(state, str(symbol))
            expected, product = str(symbol), 1.0
            for i, part in enumerate(parts):
                states[i], expected, x = part.step(states[i], expected)
                product *= x
            assert out == expected and math.isclose(weight, product)


def test_clauses_score_by_context():
    lexicon = toxicity.Lexicon({"idiot$": 3.0, "mor": 2.0})
    score = lambda text: lexicon.clause(text.split())[0]
    alone = score("an idiot here")
    assert alone == 3.0 and score("a moron") == 2.0 and score("a quiet day for you") == 0.0
    assert score("you idiot") > alone and score("idiot are you") > alone and score("you idiot you") > score("you idiot")
    assert score("not an idiot") < alone and score("he said idiot") < score("he called it so") + score("he idiot")
    assert score("she wrote idiot") < score("she idiot") and score("not idiot idiot") > score("not idiot")
    assert score("will kill you") > score("kill you") > score("kill") > 0
    assert lexicon.clause("idiot idiot".split()) == (3.0 + 3.0 * toxicity.AGAIN, 2)
    # A match is scored where its clause stands: targets of other clauses do not count.
    near, apart = lexicon.features("you idiot"), lexicon.features("you. idiot")
    assert near[0] > apart[0] and lexicon.features(None) == [0, 0, 0, 0, 0, 1.0]


def test_toxicity_scores_match_a_plain_logistic_function(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = toxicity.Model({"th": 1.0, "ing$": 2.0, "the$": 0.8}, np.array([0.5, 0.2, -0.1, 1.0, -0.3, -1.0]))
    lexicon = toxicity.Lexicon(model.odds)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    for r in docs.collect():
        assert math.isclose(got[r.doc_id], 1 / (1 + math.exp(-float(np.dot(lexicon.features(r.text), model.weights)))), rel_tol=1e-9)


def naive_log_probability(model, inputs, target):
    """Of `target` after the classes `inputs`, by plain loops."""
    p, w = model.p, len(inputs)
    x = [p["E"][i] for i in inputs]
    q = x[-1] @ p["Q"]
    s = np.array([float(q @ (v @ p["K"])) / math.sqrt(len(q)) + p["R"][w - 1 - i] for i, v in enumerate(x)])
    s = np.exp(s - s.max())
    z = x[-1] + (sum(a * (v @ p["V"]) for a, v in zip(s / s.sum(), x))) @ p["O"]
    z = z + np.maximum(z @ p["A"] + p["a"], 0) @ p["B"]
    soft = lambda v, i: float(v[i] - np.log(np.exp(v - v.max()).sum()) - v.max())
    g = model.group[target]
    return soft(z @ p["U"] + p["b"], g) + soft(z @ p["T"][g] + p["t"][g], model.member[target])


def test_attention_windows_and_masks():
    draw = np.random.default_rng(0)
    model = Attention(np.array([0, 1, 1, 0, 2, 2, 2]), np.array([0.3, 0.1, 0.1, 0.2, 0.1, 0.1, 0.1]))
    model.p["R"] = draw.standard_normal(WINDOW).astype(np.float32)
    lengths = [0, 1, WINDOW - 1, WINDOW, WINDOW + 1, WINDOW + STRIDE, 3 * WINDOW + 5]
    offsets = np.cumsum([0, *lengths])
    ids = draw.integers(0, 7, offsets[-1])
    got = model.log_probabilities(ids, offsets, most=3)
    for i, n in enumerate(lengths):
        own = ids[offsets[i] : offsets[i + 1]].tolist()
        for t in range(n):
            k = 0 if t < WINDOW else (t - WINDOW) // STRIDE + 1
            start = k * STRIDE
            assert k == 0 or t - start >= CONTEXT
            expected = naive_log_probability(model, [7, *own][start : t + 1], own[t])
            assert abs(expected - got[offsets[i] + t]) < 1e-4


def test_attention_gradients_and_learning():
    model = Attention(np.arange(7) // 3, np.full(7, 1 / 7))
    draw = np.random.default_rng(1)
    x, y = draw.integers(0, 8, (3, WINDOW)), draw.integers(-1, 7, (3, WINDOW))
    model.p = {k: a.astype(np.float64) for k, a in model.p.items()}
    _, g = model.gradients(x, y)
    for name, at in (("E", (3, 2)), ("Q", (1, 4)), ("K", (0, 0)), ("V", (5, 6)), ("R", (2,)), ("A", (3, 9)), ("T", (1, 2, 0)), ("U", (4, 1)), ("t", (0, 1)), ("b", (2,))):
        model.p[name][at] += 1e-5
        up = model.gradients(x, y)[0]
        model.p[name][at] -= 2e-5
        down = model.gradients(x, y)[0]
        model.p[name][at] += 1e-5
        assert abs((up - down) / 2e-5 - g[name][at]) < 1e-3 * max(0.05, abs(g[name][at]))
    model = Attention(np.arange(7) // 3, np.full(7, 1 / 7))
    x = np.tile(np.arange(WINDOW) % 7, (64, 1))
    y = (x + 1) % 7
    model.train(np.hstack([np.full((64, 1), 7), y[:, :-1]]), y, epochs=200)
    learned = model.log_probabilities(y[0], np.array([0, WINDOW]))
    assert learned[2:].mean() > -0.3


def test_lm_sums_match_plain_counts(spark, sf_dir, texts):
    rows = lm_scoring.lm_scores(table(spark, sf_dir, "documents"), F.col("doc_id") % 3 == 0, most=500).collect()
    word = re.compile(r"[^\x20\x09-\x0D]+")
    lower = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    tokens = {i: [*word.findall((t or "").translate(lower)), None] for i, t in texts.items()}
    counts = Counter(w for i, own in tokens.items() if i % 3 for w in own)
    n, v = sum(counts.values()), len(counts)
    for r in rows:
        own = tokens[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(w in counts for w in own), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own), rel_tol=1e-9)
    held = [r for r in rows if r.doc_id % 3 == 0]
    assert sum(r.score for r in held) / sum(r.n_tokens for r in held) > -6.5


def test_words_spelled_in_one_go_have_the_ids_of_each(texts):
    speller = lm_scoring.Speller(packing.vocabulary_path())
    odd = ["a\u00a0b \u3000x c\u2003", "\u00a0 \u00a0y", "don't 12 'll <|endoftext|> é日本 \t\n z"]
    for text in [*list(texts.values())[:20], *odd]:
        raw = (text or "").encode()
        _, keys, place, flat, bounds = speller.spell(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        for w, at in zip(re.findall(rb"[^\x20\x09-\x0D]+", raw), place):
            ids = speller.encoder.array(" " + w.lower().decode())
            assert flat[bounds[at] : bounds[at + 1]].tolist() == [2 * i + (j == len(ids) - 1) for j, i in enumerate(ids.tolist())]


def test_packing_round_trip(spark, texts, sf_dir):
    from tokenizers import Tokenizer

    path = packing.vocabulary_path()
    whole = Tokenizer.from_file(path)
    texts = texts | {-1: "a <|endoftext|> b<|endoftext|>c\n<|endoftext|>", -2: "  two  spaces\t\n\n x ", -3: None}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = packing.pack(packing.cut_pieces(docs, path, with_ids=True)).collect()
    of = {}
    for r in got:
        of.setdefault(r.doc_id, []).append(r)
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
    for doc_id, text in texts.items():
        ids = b"".join(bytes(r.ids) for r in sorted(of[doc_id], key=lambda r: r.start))
        assert np.frombuffer(ids, "<u4").tolist() == [*whole.encode(text or "", add_special_tokens=False).ids, 0]
    used = Counter()
    place = {}
    for r in got:
        used[r.sequence_id] += r.length
        place.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in place.values():
        assert [o for o, _ in sorted(own)] == [0, *np.cumsum([n for _, n in sorted(own)])[:-1].tolist()]
    assert max(used.values()) <= 1024 and sum(used.values()) / (1024 * len(used)) > 0.97


@settings(max_examples=50, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=20))
def test_histogram_packing_places_every_length(counts):
    patterns = packing.pack_histogram(counts, 64)
    placed = Counter()
    for pattern, n in patterns:
        assert sum(pattern) <= 64 and n > 0
        for length in pattern:
            placed[length] += n
    assert placed == Counter(counts)


def test_mixing_targets(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = mixing.mix(docs).collect()
    assert rows and sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(docs).collect()))
    sizes = Counter()
    for r in rows:
        sizes[r.source] += r["size"]
    names = sorted(sizes)
    left, budget, target = dict(zip(names, (5, 2, 1) * len(names))), 1.5 * sum(sizes.values()), {}
    while left:
        level = budget / sum(left.values())
        over = [s for s, w in left.items() if level * w > 2 * sizes[s]]
        if not over:
            target |= {s: level * w for s, w in left.items()}
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            budget -= target[s]
            del left[s]
    taken, largest = Counter(), Counter()
    for name in names:  # rates: the tilt of the odds whose expected tokens are the target
        own = [(r["size"], r.rate) for r in rows if r.source == name]
        if 0 < target[name] < 2 * sizes[name]:
            z = np.array([x for x, _ in own]) / max(1.0, sizes[name] / len(own))
            low, high = -60.0, 60.0
            for _ in range(200):
                lam = (low + high) / 2
                rate = 2 / (1 + np.exp(-np.clip(lam * z, -500, 500)))
                low, high = (lam, high) if rate @ np.array([x for x, _ in own]) < target[name] else (low, lam)
            assert np.abs(rate - [x for _, x in own]).max() < 1e-6
    for r in rows:
        assert math.isclose(r.target, target[r.source]) and 0 <= r.copies <= 2
        taken[r.source] += r.copies * r["size"]
        largest[r.source] = max(largest[r.source], r["size"])
    assert all(abs(taken[s] - target[s]) <= 2 * largest[s] for s in names)


def brute_lines(texts, fewest=1):
    seen, where, out = [], {}, {}
    for doc_id in sorted(texts):
        kept = []
        for line in texts[doc_id].split("\n"):
            own = frozenset(line.encode().lower().split())
            near = own in where
            if len(own) >= fewest and not near:
                shared = Counter(i for w in own for i in where.get(w, ()))
                near = any(5 * n >= 4 * (len(own) + len(seen[i]) - n) for i, n in shared.items())
                where[own] = ()
                for w in own:
                    where.setdefault(w, []).append(len(seen))
                seen.append(own)
            if len(own) < max(1, fewest) or not near:
                kept.append(line)
        out[doc_id] = "\n".join(kept)
    return out


@pytest.mark.parametrize("nearest, if_near, hot, fewest", [(64, 4, 1 << 16, 1), (1, 1, 1 << 16, 1), (8, 2, 4, 5)])
def test_lines_match_brute_force(spark, sf_dir, texts, nearest, if_near, hot, fewest, monkeypatch):
    monkeypatch.setattr(line_dedup, "NEAREST", nearest)
    monkeypatch.setattr(line_dedup, "IF_NEAR", if_near)
    monkeypatch.setattr(line_dedup, "HOT_LINES", hot)
    rng = np.random.default_rng(5)
    made = dict(texts)
    base = [f"w{i}" for i in range(40)]
    for i in range(60):  # a group of near copies whose likeness lies around the threshold
        own = list(base)
        for j in rng.choice(40, rng.integers(0, 10), replace=False):
            own[j] = f"v{rng.integers(0, 30)}"
        made[10_000 + i] = " ".join(own)
    for i in range(40):  # short, middle and long lines that repeat words and each other
        k = [1, 2, 3, 4, 5, 6, 60, 70, 230, 260][i % 10]
        line = " ".join(f"{'ABa'[i % 3]}{(j * 7 + i // 20) % (k + i // 10)}" for j in range(k))
        made[20_000 + i] = f"{line}\n\nx{i} {line}\n"
    docs = spark.createDataFrame(list(made.items()), "doc_id long, text string").repartition(5)
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(docs, fewest).collect()} == brute_lines(made, fewest)


def bag(text):
    w = text.encode().lower().split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def test_near_duplicates_match_brute_force(spark, texts):
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(300)]
    made = dict(list(texts.items())[:120])
    for i in range(40):
        own = list(base)
        for j in rng.choice(300, rng.integers(0, 9), replace=False):
            own[j] = f"v{rng.integers(0, 1000)}"
        made[10_000 + i] = " ".join(own * (2 if i % 5 == 0 else 1))
    bags = {k: bag(t) for k, t in made.items()}
    parent = {k: k for k in made}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(made)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            common = sum((bags[a] & bags[b]).values())
            if common and 5 * common >= 4 * (sum(bags[a].values()) + sum(bags[b].values()) - common):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    docs = spark.createDataFrame(list(made.items()), "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs).collect()} == {k: root(k) for k in made}


def test_large_groups_are_compared_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "CHUNK", 8)
    base = [f"w{i}" for i in range(200)]
    docs = [(i, " ".join([*base[:i], f"x{i}", *base[i + 1 :]])) for i in range(40)]
    got = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.class_id for r in got} == {0}


def test_signatures_estimate_weighted_jaccard():
    element = np.arange(400, dtype=np.uint64)
    rng = np.random.default_rng(1)
    w = rng.integers(1, 9, 400)
    v = np.where(rng.random(400) < 0.3, rng.integers(1, 9, 400), w)
    owner = np.repeat([0, 1], 400)
    sig = near_dedup.bag_minhash(owner, textkernel.mix(np.tile(element, 2)), np.concatenate([w, v]), 2, size=4000)
    assert abs((sig[0] == sig[1]).mean() - np.minimum(w, v).sum() / np.maximum(w, v).sum()) < 0.04


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 60), st.integers(1, 6))
def test_threshold_algorithm(seed, n, width):
    rng = np.random.default_rng(seed)
    v, ids = rng.integers(-3, 4, (n, width)).astype(float), rng.permutation(n)
    q = rng.integers(-3, 4, (3, width)).astype(float)
    got = vector_search.threshold_topk(v, ids, q, np.array([0, 1, 1000]), 5)
    expected = []
    for query, own in zip(q, (0, 1, 1000)):
        ranked = sorted((-int(a @ query), int(i)) for a, i in zip(v, ids) if i != own)[:5]
        expected += [(own, i, -s) for s, i in ranked]
    assert sorted(got) == sorted(expected)


def test_vector_dedup_recall(spark):
    rng = np.random.default_rng(2)
    centre = rng.standard_normal((150, 32))
    v = np.repeat(centre, 4, axis=0) + rng.standard_normal((600, 32)) * 0.1
    rows = [(i, x.tolist(), i % 2) for i, x in enumerate(v.astype(np.float32))]
    got = {r.vec_id: r.n_links for r in vector_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), leaf_rows=40).collect()}
    unit = v.astype(np.float32).astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    same = (unit @ unit.T >= 0.98) & (np.arange(600)[:, None] % 2 == np.arange(600) % 2)
    true = same.sum(axis=1) - 1
    assert all(got[i] <= true[i] for i in range(600)) and sum(got.values()) >= 0.9 * true.sum() > 0


def test_held_out_fold(spark):
    row = spark.range(1).select(F.crc32(F.lit(12).cast("string")).alias("c")).first()
    assert row.c == zlib.crc32(b"12")
