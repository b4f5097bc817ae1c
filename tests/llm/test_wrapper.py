"""Tree alignment against the plain matching, on small trees; wide pages end soon."""

import random
import time

import pytest

from tidebars.llm import wrapper
from tidebars.llm.wrapper import Page, align


def plain_weight(page, reference, a=0, b=0):
    """The largest mapping's weight by the definition: every pair of children, no memory, nothing stripped."""
    below, rbelow = wrapper._children(page), wrapper._children(reference)

    def weigh(a, b):
        if page[a, 0] != reference[b, 0]:
            return 0
        best = {}
        for i in range(len(below[a]) + 1):
            for j in range(len(rbelow[b]) + 1):
                best[i, j] = 0 if not i or not j else max(best[i - 1, j], best[i, j - 1], best[i - 1, j - 1] + weigh(below[a][i - 1], rbelow[b][j - 1]))
        return (3 if page[a, 2] == reference[b, 2] else 2) + best[len(below[a]), len(rbelow[b])]

    return weigh(a, b)


def weight(pairs, page, reference):
    return sum(3 if page[i, 2] == reference[j, 2] else 2 for i, j in pairs)


def is_ordered(pairs, page, reference):
    """One partner each, parents of pairs are pairs, and siblings keep their order."""
    ups, rups = wrapper._parents(page), wrapper._parents(reference)
    held = set(pairs)
    one = len({i for i, _ in pairs}) == len(pairs) == len({j for _, j in pairs})
    return one and all((ups[i], rups[j]) in held for i, j in pairs if i) and [j for _, j in sorted(pairs)] == sorted(j for _, j in pairs)


def tree(draw, depth):
    name, text = draw.choice("div b i".split()), draw.choice(["", "x", "y", f"z{draw.randint(0, 99)}"])
    return f"<{name}>{text}{''.join(tree(draw, depth - 1) for _ in range(draw.randint(0, 4) if depth else 0))}</{name}>"


def skeletons(*sources):
    return [Page(f"<html><body><article>{s}</article></body></html>").skeleton() for s in sources]


def test_alignment_is_the_largest():
    draw = random.Random(4)
    for _ in range(300):
        a, b = skeletons(*("".join(tree(draw, 3) for _ in range(3)) for _ in range(2)))
        found = align(a, b)
        assert weight(found, a, b) == plain_weight(a, b) and is_ordered(found, a, b)
        assert sorted(align(a, b, exact_cells=None)) == sorted(found)
        for rough in (align(a, b, exact_cells=0), align(a, b, stretch=2)):
            assert is_ordered(rough, a, b) and weight(rough, a, b) <= weight(found, a, b)


@pytest.mark.parametrize("rows", [400, 4000])
def test_wide_tables_end_soon(rows):
    draw = random.Random(rows)
    a, b = skeletons(*("<table>" + "".join("<tr>" + "".join(f"<td>{draw.randint(0, 50)}</td>" for _ in range(6)) + "</tr>" for _ in range(rows)) + "</table>" for _ in range(2)))
    begun = time.monotonic()
    found = align(a, b)
    assert time.monotonic() - begun < 20 and is_ordered(found, a, b) and len(found) > 0.99 * len(a)


def test_a_row_put_in_moves_the_rest():
    rows = [f"<tr><td>name {k}</td><td>{k % 7}</td></tr>" for k in range(3000)]
    a, b = skeletons("<table>" + "".join(rows) + "</table>", "<table>" + "".join(rows[:1500] + ["<tr><td>new</td><td>1</td></tr>"] + rows[1500:]) + "</table>")
    found = align(a, b)
    assert len(found) == len(a) and weight(found, a, b) == 3 * len(a)


def test_lowest_over_many_nodes():
    parents = [0] + [(k - 1) // 3 for k in range(1, 40000)]
    assert wrapper._lowest_over(set(range(20000, 40000)), parents) == 0
    assert wrapper._lowest_over({13, 14, 41}, parents) == 4 and wrapper._lowest_over({7}, parents) == 7 and wrapper._lowest_over(set(), parents) is None


def test_extraction_of_a_wide_page(spark):
    page = "<html><body><div><p>Follow us</p></div><article>{0}</article></body></html>"
    rows = [(k, f"http://w/{k}", page.format("".join(f"<p>line {i} of {k}</p>" for i in range(5000)))) for k in range(5)]
    found = {r["page_id"]: r["text"] for r in wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found[2] == "\n".join(f"line {i} of 2" for i in range(5000))
