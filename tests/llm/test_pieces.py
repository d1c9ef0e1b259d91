from __future__ import annotations

import random

from notelake.llm import pieces as pc


def check(text, limit=1200, overlap=150):
    parts = pc.split_text(text, limit, overlap)
    assert "".join(text[b:c] for _, b, c, _ in parts) == text
    edges = [0, *pc.cut_points(text), len(text)]
    for (a, b, c, _), before in zip(parts, [None, *parts], strict=False):
        assert c - a <= limit and 0 <= b - a <= overlap and (before is None or a >= before[1])
    forced = any(y - x > limit for x, y in zip(edges, edges[1:], strict=False))
    assert any(p[3] for p in parts) == (forced and len(text) > limit)
    if not forced:
        assert all(b in edges for _, b, _, _ in parts)
    return parts


def test_round_trip_on_random_markdown():
    r = random.Random(1)
    bits = ["# Head\n", "## Sub\r\n", "A sentence here. ", "문장 하나다. ", "日本語の文。 ", "- item\n", "  - nested item text\n", "\n\n", "\n", "| a | b |\n", "```\ncode\n\nmore\n```\n", "word " * 30, "x" * 90]
    for _ in range(300):
        check("".join(r.choices(bits, k=r.randint(1, 120))), r.choice([60, 200, 1200]), r.choice([0, 10, 50]))


def test_forced_and_edge_cases():
    assert pc.split_text("") == [(0, 0, 0, False)]
    assert len(check("a" * 1200)) == 1
    assert all(p[3] for p in check("a" * 5000))
    assert not any(p[3] for p in check(("b" * 1199 + "\n") * 4))
    assert any(p[3] for p in check("b" * 1201 + "\n" + "c. " * 900))
    check("no stop " * 400)
    check("é. " * 3000)


def test_cuts_prefer_the_structure():
    section = "# T{}\n\n" + "Some words in a line here. " * 20 + "\n\n"
    text = "".join(section.format(i) for i in range(4))
    assert all(text[b:].startswith("# T") for _, b, _, _ in pc.split_text(text, 700, 60))


def test_nested_lists_are_a_tree():
    text = "- a\n- b\n  - deep\n    more of deep\n  - deep too\n- c\n"
    items = pc.parse(text)[2][0][2]
    assert [text[a:b] for a, b, _ in items] == ["- a\n", "- b\n  - deep\n    more of deep\n  - deep too\n", "- c\n"]
    inner = items[1][2][1]
    assert [text[a:b] for a, b, _ in inner[2]] == ["  - deep\n    more of deep\n", "  - deep too\n"]
    pc.parse("".join(" " * i + "- x\n" for i in range(3000)))


def test_sub_lists_are_kept_together():
    text = "".join(f"- item {i}\n" + "  - sub item of it\n" * 5 for i in range(30))
    assert all(text[b:].startswith("- item") for _, b, _, _ in pc.split_text(text, 300, 0))


def parents(node, out):
    """Each node with children, with the spans of these."""
    if node[2]:
        out.append([c[:2] for c in node[2]])
        for c in node[2]:
            parents(c, out)
    return out


def test_no_piece_mixes_parts_of_two_parents():
    """A piece is a run of whole children of one node, or lies inside a leaf."""
    r = random.Random(3)
    bits = ["# Head\n", "## Sub\n", "A sentence here. ", "- item\n", "  - nested item text\n", "    - deeper\n", "\n\n", "\n", "word " * 10]
    for _ in range(200):
        text, limit = "".join(r.choices(bits, k=r.randint(5, 150))), r.choice([60, 150, 400])
        tree = pc.parse(text)
        runs = {(kids[i][0], kids[j][1]) for kids in parents(tree, [[tree[:2]]]) for i in range(len(kids)) for j in range(i, len(kids))}
        leaves = [kid for kids in parents(tree, []) for kid in kids]
        for _, b, c, forced in pc.split_text(text, limit, 0):
            assert (b, c) in runs or forced and any(x <= b and c <= y for x, y in leaves)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id string, chunk_index int, content string, section_path string, pieces string")


def test_numbers_have_no_gaps_and_repeats_count_once(spark):
    long = "A sentence of words. " * 200
    rows = [("hot", i, long if i % 3 else "short", f"s{i}", "clash") for i in range(40)] + [("hot", 1, long, "s1", "clash"), ("b", 0, None, None, None), ("b", 1, "", "x", None), ("b", 2, "tail", "x", None), (None, 0, "lost", None, None)]
    out = pc.renumbered_pieces(frame(spark, rows)).collect()
    by: dict = {}
    for r in out:
        by.setdefault(r.doc_id, []).append((r.chunk_index, r.from_chunk))
    for numbers in by.values():
        numbers.sort()
        assert [n for n, _ in numbers] == list(range(len(numbers))) and [f for _, f in numbers] == sorted(f for _, f in numbers)
    assert len(by["b"]) == 1 and len(by[None]) == 1 and len(by["hot"]) == 14 + 26 * len(pc.split_text(long))
    assert {r.section_path for r in out if r.doc_id == "hot"} == {f"s{i}" for i in range(40)}


def test_empty_table(spark):
    assert pc.renumbered_pieces(frame(spark, [])).count() == 0 and pc.split_chunks(frame(spark, [])).count() == 0


def test_kinds(spark):
    rows = [("a", 0, "x", "", ""), ("a", 1, "word. " * 300, "", ""), ("a", 2, "y" * 2000, "", "")]
    assert {r.chunk_index: r.cut_kind for r in pc.split_chunks(frame(spark, rows)).collect()} == {0: "whole", 1: "natural", 2: "forced"}
    assert pc.split_chunks(frame(spark, rows), longer_than=1200).count() == 2
