from __future__ import annotations

import random

import pytest

from commentlab.llm import ngram_join as J
from commentlab.llm import queries
from commentlab.llm.components import connected_components
from tests.conftest import SF_SMALL
from tests.llm.brute import jaccard_answer

SCHEMA = "doc_id bigint, text string, root string, n int"


def near_copies(n_bases: int, copies: int, seed: int = 5) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for base in range(n_bases):
        words = [f"W{rng.randrange(3000)}" for _ in range(rng.choice([6, 30, 80, 200]))]
        for c in range(copies):
            edited = list(words)
            for _ in range(rng.randrange(0, 1 + len(words) // 15)):
                edited[rng.randrange(len(edited))] = f"x{rng.randrange(10**6)}"
            rows.append((1000 * base + c, " ".join(edited), None, 1))
    return rows


def answer(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = J.similarity_components(df).select("doc_id", "n_shingles", "component_id").collect()
    return sorted(map(tuple, got), key=repr)


def test_equals_brute_force_on_near_copies_and_edge_cases(spark):
    rows = near_copies(12, 8)
    rows += [
        (1, None, "a", 1), (2, "", "a", 1), (3, " \t\n ", "a", 1),
        (4, "one two", "b", 2), (5, "ONE\ttwo", "b", 2), (6, "one two three", None, 3),
        (7, "same row " * 9, "c", 1), (7, "same row " * 9, "c", 1),
        (8, "Ünï çode wörds gehen auch hier Ä", "c", 1), (9, "Ünï çode wörds gehen auch hier ä", "c", 1),
        (None, "one two three four five six", "d", 1), (None, "one two three four five six", "d", 1), (900, "one two three four five six", "d", 1),
        (901, "long " + " ".join(f"t{i}" for i in range(30000)), "e", 1), (902, "longer " + " ".join(f"t{i}" for i in range(30000)), "e", 1),
    ]
    assert answer(spark, rows) == sorted(jaccard_answer([r[:2] for r in rows]), key=repr)


def test_small_blocks_cross_in_the_same_way(spark, monkeypatch):
    rows = near_copies(3, 60, seed=11)
    want = sorted(jaccard_answer([r[:2] for r in rows]), key=repr)
    monkeypatch.setattr(J, "BLOCK", 7)
    assert answer(spark, rows) == want


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(tuple(r) for r in queries.QUERIES["op6_multi_order_join"](spark, SF_SMALL).select("doc_id", "n_shingles", "component_id").collect())
    assert got == sorted(jaccard_answer([tuple(r) for r in docs]))


@pytest.mark.parametrize("n", range(7))
def test_few_words_in_all(n):
    text = " ".join(f"w{i}" for i in range(n))
    for texts in ([text], ["", text, ""], [text, "a b c d e f g"]):
        doc, token = J.Shingler().shingles(texts)
        assert [(doc == i).sum() for i in range(len(texts))] == [max(len(w) - 4, min(1, len(w))) for w in map(str.split, texts)]
        assert set(J.Shingler().shingles([text])[1].tolist()) == set(token[doc == texts.index(text)].tolist())


@pytest.mark.parametrize("text", ["one two", "one two three"])
def test_one_short_row(spark, text):
    assert answer(spark, [(1, text, None, 1)]) == sorted(jaccard_answer([(1, text)]), key=repr)


def test_empty_table(spark):
    assert answer(spark, []) == []


def test_one_of_each_keeps_the_smallest(spark):
    rows = near_copies(4, 5, seed=3) + [(77, None, None, 1), (78, "", None, 1)]
    kept = {r["doc_id"] for r in J.one_of_each(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = {c for _, n, c in jaccard_answer([r[:2] for r in rows])}
    assert kept == want


@pytest.mark.parametrize("edges", [[(1, 2), (2, 3), (5, 5), (None, 4), (9, 7)], [(i, i + 1) for i in range(70)], [(0, i) for i in range(1, 200)], []])
def test_components(spark, edges):
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a int, b int")).collect()}
    root = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}
    for _ in root:
        for a, b in edges:
            if a in root and b in root:
                root[a] = root[b] = min(root[a], root[b])
    assert got == root


def test_shingles_tell_all_words_apart_and_hold_none_of_them():
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abé") for _ in range(n)) for n in [*range(1, 20), 255, 256, 257, 300] for _ in range(9)})
    texts = [" \t" + "\x0b".join(rng.choice(words) for _ in range(rng.randrange(0, 40))) + "\r\n" for _ in range(200)]
    texts += ["", " ", "a", "A b", "a  B", "b a", "a b c d", "a b c d e", "x" * 256 + " y", "x" * 257 + " y", "x" * 8 + " y", "x" * 9 + " y", "a b c", "a\x00 b", "a b\x00"]
    texts += [w for w in words] + [w.upper() for w in words]

    def shingles(text):
        found = text.encode().lower().split()
        return {tuple(found[i : i + 5]) for i in range(len(found) - 4)} if len(found) > 4 else ({tuple(found)} if found else set())

    shingler = J.Shingler()
    ends, tokens = shingler.sets(texts)
    sets = [tokens[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)]
    named = {}
    for text, got in zip(texts, sets, strict=True):
        want = shingles(text)
        assert len(got) == len(want) == len(set(got)) and got == sorted(got)
        for token in got:
            named.setdefault(token, []).append(want)
    for wants in named.values():
        assert set.intersection(*wants)  # a token stands for a shingle that all its texts hold
    assert len(named) == len(set().union(*map(shingles, texts)))
    assert not vars(shingler)


def test_prefix_is_the_smallest_keys_of_every_set():
    rng = random.Random(4)
    sets = [sorted(rng.sample(range(1 << 20), n)) for n in (0, 1, 2, 5, 0, 60, 200)]
    ends = J.np.cumsum([0, *map(len, sets)])
    tokens = J.np.array([t for s in sets for t in s], dtype=J.np.uint64)
    levels = J.np.array([rng.randrange(3) for _ in range(J.BUCKETS)], dtype=J.np.uint8)
    owner, token = J.prefixes(ends, tokens, levels, J.ORDERS[1])
    for i, s in enumerate(sets):
        key = {t: (int(levels[t]), int(J._mix(J.np.array([t ^ J.ORDERS[1]], dtype=J.np.uint64))[0])) for t in s}
        want = sorted(s, key=key.get)[: int(J.prefix_length(J.np.array([len(s)]))[0])]
        assert sorted(token[owner == i].tolist()) == sorted(want)


def strangers(n: int, shared: str, at: int = 0) -> list[tuple]:
    """Texts of words of their own, alike in one line."""
    return [(i, " ".join(f"d{i}w{j}" for j in range(60)) + "\n" + shared, None, 1) for i in range(at, at + n)]


def line(name: str, words: int) -> str:
    return " ".join(f"{name}{i}" for i in range(words))


def test_large_groups_send_whole_sets_of_possible_partners_only(spark, monkeypatch):
    copies = near_copies(1, 12, seed=2)
    rows = [r for k in range(20) for r in strangers(3, line(f"k{k}n", 12), at=10000 + 3 * k)] + copies
    want = sorted(jaccard_answer([r[:2] for r in rows]), key=repr)
    sent, texts_of = [], J._texts_of
    monkeypatch.setattr(J, "_texts_of", lambda docs, wanted: sent.append(wanted.count()) or texts_of(docs, wanted))
    monkeypatch.setattr(J, "BLOCK", 2)
    assert answer(spark, rows) == want
    assert sent[0] <= len(copies)  # strangers in groups of two blocks went too, as whole sets


def test_partners_in_other_blocks_are_found(spark, monkeypatch):
    some = strangers(40, line("common", 40))
    rows = some + [(100 + i, t + " changed", None, 1) for i, t, *_ in some[::9]]
    monkeypatch.setattr(J, "BLOCK", 3)
    assert answer(spark, rows) == sorted(jaccard_answer([r[:2] for r in rows]), key=repr)


def test_a_line_that_no_task_holds_often_is_no_prefix(spark, monkeypatch):
    rows = strangers(48, line("common", 20))
    found, number = [], J._number_classes
    monkeypatch.setattr(J, "_number_classes", lambda described, by_leader: found.append(by_leader.count()) or number(described, by_leader))
    df = spark.createDataFrame(rows, SCHEMA).repartitionByRange(24, "doc_id")
    assert J.similarity_components(df).select("component_id").distinct().count() == 48
    assert found == [0]


def test_tokens_of_rare_words_come_first():
    common = J.np.zeros(J.WORD_BUCKETS, dtype=J.np.uint8)
    often, rare = [f"of{i}" for i in range(30)], [f"seldom{i}" for i in range(30)]
    common[(J._words([" ".join(often)])[0] & J._U(J.WORD_BUCKETS - 1)).astype(int)] = 40
    levels = J.np.zeros(J.BUCKETS, dtype=J.np.uint8)
    shingler = J.Shingler(common)
    _, first = J.prefixes(*shingler.sets([" ".join(often + rare)]), levels, J.ORDERS[0])
    _, of_rare = shingler.sets([" ".join(rare)])
    assert len(first) and set(first.tolist()) <= set(of_rare.tolist())
    assert set(of_rare.tolist()) <= set(shingler.sets([" ".join(often + rare)])[1].tolist())  # by the shingle, not the text
