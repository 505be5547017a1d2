"""The parts that need no Spark, against plain versions."""

import itertools
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from trajecta.llm import near_dedup
from trajecta.llm.ann import best_of, fit_forest, lift
from trajecta.llm.decontamination import Matcher, myers, normalise, pieces_of
from trajecta.llm.packing import plan_bins
from trajecta.llm.token_binary import ShardReader, repair_compress
from trajecta.llm.token_counts import CountTree, segments_of
from trajecta.llm.tokens import PieceEncoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "  a", "a b", " a b ", "it's  ok", "a\n b", "a\n\nb c\t d", "é ñ  x y", "x<|endoftext|>y z", "nul \0a \0", "don't we'll 12 345,6 !!! ??", "a\n", "\na", "a \nb"]


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda t: tokenizer.encode(t or "", add_special_tokens=False).ids


def scraps(n, alphabet="ab  \n'sé1! \t", most=60, seed=1):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, most))) for _ in range(n)]


def test_piece_encoder_gives_the_ids_of_whole_texts(plain):
    enc = PieceEncoder(PATH, 200)
    for texts in ([None, *ODD], scraps(400), scraps(400, "ab c.", seed=2)):
        for text, ids in zip(texts, enc.encode_many(texts), strict=True):
            assert ids.tolist() == plain(text), text


def test_other_tokenizers_are_encoded_whole():
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, enc = Tokenizer.from_file(path), PieceEncoder(path, 100)
    for text, ids in zip(ODD, enc.encode_many(ODD), strict=True):
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_repair_round_trip_and_random_access():
    rnd = random.Random(4)
    for n_docs in (1, 3, 40):
        docs = [np.array([rnd.choice([2, 5, 9, 50_000, 7]) for _ in range(rnd.randint(1, 400))], dtype=np.uint32) for _ in range(n_docs)]
        docs.append(np.full(300, 5, dtype=np.uint32))
        ids, sizes = np.concatenate(docs), np.array([len(d) for d in docs])
        alphabet, rules, lengths, seq, symbols = repair_compress(ids, sizes, min_count=2)
        reader = ShardReader(2, alphabet.astype("<u4").tobytes(), rules.astype("<u2").tobytes(), lengths.astype("<u4").tobytes(), seq.astype("<u2").tobytes())
        assert (reader.all() == ids).all() and len(seq) == symbols.sum() and (n_docs < 40 or len(seq) < len(ids))
        at = 0
        for d, n in zip(docs, symbols, strict=True):  # a document is a range of symbols
            assert (reader.expand(reader.sequence[at : at + n]) == d).all()
            at += n
        for _ in range(50):
            a = rnd.randint(0, len(ids))
            b = rnd.randint(a, len(ids))
            assert (reader.tokens(a, b) == ids[a:b]).all()


def test_repair_leaves_no_pair_that_recurs_without_overlap():
    rng = np.random.default_rng(3)
    docs = [rng.integers(0, 6, int(n)).astype(np.uint32) for n in rng.integers(1, 500, 30)] + [np.full(2**11, 3, dtype=np.uint32)] * 2
    ids, sizes = np.concatenate(docs), np.array([len(d) for d in docs])
    alphabet, rules, lengths, seq, symbols = repair_compress(ids, sizes, min_count=4)
    cuts = np.split(seq, np.cumsum(symbols)[:-1])
    seen = Counter()
    for part in cuts:
        last = {}
        for i, p in enumerate(zip(part.tolist(), part.tolist()[1:], strict=False)):
            if last.get(p, -2) != i - 1:  # a run counts every other place
                seen[p] += 1
                last[p] = i
    assert max(seen.values(), default=0) < 4 and len({tuple(r) for r in rules.tolist()}) == len(rules)
    assert (lengths >= 2).all() and lengths.max() >= 64


def test_repair_of_many_distinct_ids_takes_four_bytes():
    ids = np.concatenate([np.arange(70_000), np.tile([69_999, 5], 30)]).astype(np.uint32)
    alphabet, rules, lengths, seq, _ = repair_compress(ids, np.array([len(ids)]), min_count=8)
    reader = ShardReader(4, alphabet.astype("<u4").tobytes(), rules.astype("<u4").tobytes(), lengths.astype("<u4").tobytes(), seq.astype("<u4").tobytes())
    assert len(rules) and (reader.all() == ids).all()


def place(counts, capacity):
    bins, by_size = {}, {}
    for size, rank, first, offset in plan_bins(counts, capacity):
        by_size.setdefault(size, []).append((rank, first, offset))
    for size, parts in by_size.items():
        parts = sorted(parts) + [(counts[size], 0, 0)]
        for (r0, first, offset), (r1, _, _) in zip(parts, parts[1:], strict=False):
            for r in range(r0, r1):
                bins.setdefault(first + r - r0, []).append((offset, size))
    return bins


@pytest.mark.parametrize("capacity", [10, 64, 2048])
def test_plan_places_every_item_once_without_gaps(capacity):
    rnd = random.Random(capacity)
    for _ in range(60):
        sizes = [rnd.randint(1, capacity) for _ in range(rnd.randint(0, 200))]
        bins = place(Counter(sizes), capacity)
        assert sorted(s for b in bins.values() for _, s in b) == sorted(sizes)
        for content in bins.values():
            at = 0
            for offset, size in sorted(content):
                assert offset == at
                at += size
            assert at <= capacity
            assert sum(3 * s > capacity for _, s in content) <= 2
        assert len(bins) <= 1.25 * max(sum(sizes) / capacity, sum(2 * s > capacity for s in sizes)) + 2


def test_plan_rejects_sizes_over_the_capacity():
    with pytest.raises(ValueError):
        plan_bins({11: 1}, 10)


def edit_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern):
        new = [i + 1]
        for j, d in enumerate(text):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_myers_distance():
    rnd = random.Random(5)
    for _ in range(600):
        p, t = ("".join(rnd.choice("ab ") for _ in range(rnd.randint(lo, hi))) for lo, hi in ((1, 12), (0, 25)))
        hit, want = myers(p, t, len(p) - 1), edit_distance(p, t)
        assert (hit[0] if hit else len(p)) == want


def test_matcher_finds_what_brute_force_finds():
    rnd = random.Random(6)
    words = ["river", "stone", "cloud", "a", "of", "the", "bright", "under", "seven"]
    item = lambda: " ".join(rnd.choice(words) for _ in range(18))
    items = [(i, item()) for i in range(12)] + [(99, ""), (98, "Tiny!")]
    docs = []
    for _ in range(60):
        own = list(rnd.choice(items[:12])[1])
        for _ in range(rnd.randint(0, 9)):
            own[rnd.randrange(len(own))] = rnd.choice("xyz ")
        docs.append(f"{item()}. {''.join(own)}, {item()}")
    m = Matcher(items, 0.08, 12)
    for d in [*docs, "", None, "say TINY"]:
        want = {i: n for (i, own, budget) in m.items if (n := edit_distance(own, normalise(d))) <= budget}
        assert {i: n for i, n, _ in m.find(d)} == want


def test_pieces_cover_the_item():
    assert "".join(p for _, p in pieces_of("abcdefghijk", 3)) == "abcdefghijk"


def test_count_tree_matches_encoding_the_edited_text(plain):
    enc, rnd = PieceEncoder(PATH, 5000), random.Random(7)
    for text in [*scraps(150, seed=8), "", "word " * 300]:
        segs = segments_of(text, 8)
        assert "".join(segs) == text
        tree = CountTree(segs, [len(x) for x in enc.encode_many(segs)])
        assert tree.total == len(plain(text))
        for _ in range(4):
            start, length, new = rnd.randint(0, len(text) + 3), rnd.randint(0, 12), "".join(rnd.choice("ab \n'") for _ in range(rnd.randint(0, 5)))
            tree.edit(start, length, new, enc)
            text = text[:start] + new + text[start + length :]
            assert tree.text() == text and tree.total == len(plain(text))
    assert tree.encoded_chars < 4 * 200  # of 1500 characters


def test_shingles_and_signature():
    h = lambda text: near_dedup.word_hashes(text.encode())[0]
    words = "a b\u00a0\u00e9c d e f\x1cg".split(" ")
    odd = "A\tb\u00a0\u00e9C\r\n D  e\x0bf\x1cG "
    for stretch in (3, 5, 1 << 20):
        found, starts = near_dedup.word_hashes(odd.encode(), stretch)
        assert found.tolist() == [int(h(w)[0]) for w in words] and [odd.encode()[i : i + 1].lower() for i in starts] == [w[:1].encode() for w in words]
    assert len(set(found.tolist())) == 5 and h("\u00c9")[0] != h("\u00e9")[0] and len(h("")) == len(h(" \n")) == 0
    pool = {"".join(t) for n in (1, 2, 3, 4) for t in itertools.product("abcdefgh\u00e9", repeat=n)}
    assert len(set(h(" ".join(pool)).tolist())) == len(pool)
    assert len(near_dedup.shingle_set(h("a b c d"))) == 1 and len(near_dedup.shingle_set(h("a b c d f"))) == 2
    assert len(near_dedup.shingle_set(h("a"))) == 1 and len(near_dedup.shingle_set(h(""))) == 0
    rnd = random.Random(1)
    texts = [[rnd.choice("xyz") for _ in range(n)] for n in (0, 1, 3, 4, 5, 90, 0, 2, 300, 4)]
    flat, sizes = near_dedup.shingle_sets_of(h(" ".join(w for t in texts for w in t)), np.array([len(t) for t in texts]))
    plain = [{tuple(t[i : i + 4]) for i in range(max(len(t) - 3, 1))} if t else set() for t in texts]
    assert sizes.tolist() == [len(p) for p in plain]
    for part, t in zip(np.split(flat, np.cumsum(sizes)[:-1]), texts, strict=True):
        assert part.tolist() == near_dedup.shingle_set(h(" ".join(t))).tolist()
    rng = np.random.default_rng(0)
    perms = near_dedup.permutations(288)
    for share in (0.5, 0.8, 0.95):
        pool = rng.integers(0, 2**63, 3000, dtype=np.uint64)
        n = int(2000 * share / (1 + share) * 1.5)
        a, b = np.sort(pool[:1500]), np.sort(np.concatenate([pool[:n], pool[1500 : 3000 - n]]))
        jac = n / (3000 - n)
        found = near_dedup.min_max_signatures(np.concatenate([a, b]), np.array([1500, 1500]), perms)
        assert abs((found[:, 0] == found[:, 1]).mean() - jac) < 0.09


@pytest.mark.parametrize("shared,size", [(4, 5), (8, 10), (80, 100)])
def test_bands_miss_a_pair_at_the_threshold_as_seldom_as_said(shared, size):
    """Of 2000 pairs at similarity 0.8, small sets included, each of 72 bands agrees at about 0.8**8."""
    rng, bands, rows = np.random.default_rng(size), near_dedup.BANDS, near_dedup.ROWS
    pools = rng.integers(0, 2**63, (2000, size), dtype=np.uint64) * np.uint64(2)
    flat = np.concatenate([np.concatenate([np.sort(p[:-1] if shared == size - 1 else p[: (size + shared) // 2]), np.sort(p if shared == size - 1 else np.concatenate([p[:shared], p[(size + shared) // 2 :]]))]) for p in pools])
    n = np.tile([size - 1, size] if shared == size - 1 else [(size + shared) // 2] * 2, 2000)
    keys = near_dedup.band_keys(near_dedup.min_max_signatures(flat, n, near_dedup.permutations(bands * rows // 2)), bands, rows)
    same = keys[:, ::2] == keys[:, 1::2]
    assert abs(same.mean() - 0.8**rows) < 0.02 and same.any(axis=0).all()


def test_spanning_links_join_what_brute_force_joins():
    rng = np.random.default_rng(1)
    sets = []
    for _ in range(12):
        base = rng.integers(0, 2**60, 80, dtype=np.uint64)
        for drop in (0, 4, 9, 14, 25):
            sets.append(np.unique(np.concatenate([base[drop:], rng.integers(0, 2**60, drop // 2, dtype=np.uint64)])))
    names = list(range(len(sets)))
    found = near_dedup.spanning_links(names, np.arange(len(sets)), sets, 80)
    parent = list(names)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in found:
        assert near_dedup.linked(sets[a], sets[b], 80)
        parent[root(a)] = root(b)
    for i in names:
        for j in names[i + 1 :]:
            if near_dedup.linked(sets[i], sets[j], 80):
                assert root(i) == root(j)


def test_forest_puts_every_row_in_one_leaf_a_tree_and_visits_all():
    x = lift(np.random.default_rng(2).standard_normal((500, 8)), 10.0)
    forest = fit_forest(x, 3, 4)
    leaves = forest.leaves(x)
    counts = np.stack([np.bincount(leaves[:, t], minlength=16) for t in range(3)])
    assert (counts.sum(axis=1) == 500).all()
    order = forest.visit(x[0], counts, np.inf)
    assert len(order) == len(set(order)) == 48
    assert order[0][1] == leaves[0, order[0][0]]


def test_best_of_breaks_ties_by_id():
    x = np.ones((6, 2))
    ids, _ = best_of(np.full(6, 2.0), np.array([9, 3, 7, 1, 8, 2]), x, np.ones(2), 3)
    assert ids.tolist() == [1, 2, 3]


def test_language_models_are_interpolated_kneser_ney():
    """Every probability against a plain recursion over dictionaries of counts."""
    from trajecta.llm.language_id import codes_of, fit_models, letters_only

    order, discount = 3, 0.75
    texts = {"a": ["abba cab bac abcab", "cab a bab"], "b": ["dda bad dab", "add a dad bad"]}
    clean = {k: [letters_only(t) for t in v] for k, v in texts.items()}
    model = fit_models(clean, order, discount)
    joined = {k: "".join("".join(map(chr, codes_of(t).tolist())) for t in v) for k, v in clean.items()}
    vocabulary = len({c for t in joined.values() for c in t[1:]}) + 1
    for j, lang in enumerate(model.langs):
        text = joined[lang]
        counts = {order: Counter(text[i : i + order] for i in range(len(text) - order + 1))}
        for k in range(1, order):  # lower orders: distinct characters before a gram
            counts[k] = Counter(g[1:] for g in {text[i : i + k + 1] for i in range(len(text) - k)})

        def p(gram, counts=counts):
            k, context = len(gram), gram[:-1]
            lower = p(gram[1:]) if k > 1 else 1 / vocabulary
            own = {g: n for g, n in counts[k].items() if g[:-1] == context}
            total = sum(own.values())
            return (max(own.get(gram, 0) - discount, 0) + discount * len(own) * lower) / total if total else lower

        for probe in ("cab", "abb", "bac", "dda", "dad", " ba", "b a"):
            got = model.score(np.array([ord(c) for c in probe], dtype=np.uint64))[0, j]
            assert got == pytest.approx(np.log(p(probe)), abs=1e-4), (lang, probe)


def test_pu_risk_and_its_gradient():
    from trajecta.llm.toxicity import risk_and_gradient

    rng = np.random.default_rng(2)
    for shift in (0.5, 2.0):
        zp, zu, prior = rng.standard_normal(7) + 1, rng.standard_normal(11) + shift, 0.3
        risk, gp, gu = risk_and_gradient(zp, zu, prior)
        plus, minus = (lambda z: np.log1p(np.exp(-z)).mean()), (lambda z: np.log1p(np.exp(z)).mean())
        assert minus(zu) > prior * minus(zp)
        assert risk == pytest.approx(prior * plus(zp) + minus(zu) - prior * minus(zp))
        for z, g in ((zp, gp), (zu, gu)):
            for i in range(len(z)):
                z[i] += 1e-6
                assert (risk_and_gradient(zp, zu, prior)[0] - risk) / 1e-6 == pytest.approx(g[i], abs=1e-4)
                z[i] -= 1e-6
    zp, zu = np.full(5, 3.0), np.full(9, -6.0)  # unlabelled rows fitted too well: only the reversed part moves
    risk, gp, gu = risk_and_gradient(zp, zu, 0.5)
    assert risk == pytest.approx(0.5 * np.log1p(np.exp(-3.0))) and (gp > 0).all() and (gu < 0).all()


def test_classifier_scores_do_not_depend_on_the_order_of_words():
    from trajecta.llm.toxicity import Classifier

    rng = random.Random(4)
    words = ["".join(p) for p in itertools.product("abcde", repeat=4)]
    model = Classifier({w: rng.uniform(-1, 1) for w in words}, -0.5)
    scores = {model.score(" ".join(rng.sample(words, len(words)))) for _ in range(5)}
    assert len(scores) == 1
