"""Lists of many unlike children are aligned as a whole."""

import random

import pytest

from inkspark.llm import wrapper


def match(a, b):
    shapes = wrapper.Shapes()
    return wrapper.match(*(wrapper.numbered(x, wrapper.hashes_of(x), shapes) for x in (a, b)), shapes)


def heaviest(one, two, weight):
    row = [0] * (len(two) + 1)
    for x in one:
        new = [0]
        for j, y in enumerate(two):
            new.append(max(new[j], row[j + 1], row[j] + weight(x, y)))
        row = new
    return row[-1]


def test_unlike_children_far_from_their_place_meet():
    """300 texts, after 300 others on the one page and before 300 others on the other."""
    page = lambda names: wrapper.tree_of("".join(f"<p>{x}</p>" for x in names))
    same = [f"same {k}" for k in range(300)]
    a, b = page([*(f"a{k}" for k in range(300)), *same]), page([*same, *(f"b{k}" for k in range(300))])
    # All 600 paragraphs of either match by shape; with the 300 of equal texts only 300 would.
    assert len(match(a, b)) == 1 + 2 * 600
    many = lambda kinds: wrapper.tree_of("".join(f"<div class='c{k}'>{k}</div>" for k in kinds))
    pairs = match(many([*range(300), *range(1000, 1300)]), many([*range(2000, 2300), *range(300)]))
    assert len(pairs) == 1 + 2 * 300


@pytest.mark.parametrize("pairs", [4_000_000, 50, 1])
def test_alignment_is_heaviest_at_any_table_size(monkeypatch, pairs):
    monkeypatch.setattr(wrapper, "PAIRS", pairs)
    draw = random.Random(5)
    for _ in range(30):
        tree = lambda: "".join(f"<div class='{draw.choice('ab')}'>" + "".join(draw.choice(("<p>x", "<ul><li>1<li>2</ul>", "<h2>t</h2>")) for _ in range(draw.randrange(4))) + "</div>" for _ in range(draw.randrange(12)))
        shapes = wrapper.Shapes()
        a, b = (wrapper.numbered(x, wrapper.hashes_of(x), shapes) for x in (wrapper.tree_of(tree()), wrapper.tree_of(tree())))

        def size(i, j):
            if a.tree.label[i] != b.tree.label[j]:
                return 0
            return 1 + heaviest(a.tree.children[i], b.tree.children[j], size)

        got = wrapper.match(a, b, shapes)
        assert len(got) == size(0, 0) == shapes.size(a.shape[0], b.shape[0]) and len(set(got)) == len({i for i, _ in got}) == len({j for _, j in got})


def test_sizes_are_the_same_when_few_are_kept(monkeypatch):
    pages = ["".join(f"<div><p>x{'<ul><li>' * (k % m)}</ul></ul></ul></div>" for k in range(40)) for m in (3, 4)]
    sizes = []
    for most in (500_000, 2):
        monkeypatch.setattr(wrapper, "KNOWN", most)
        monkeypatch.setattr(wrapper, "UNLIKE", most)
        shapes = wrapper.Shapes()
        one, two = (shapes.of(wrapper.tree_of(x))[0] for x in pages)
        sizes.append(shapes.size(one, two))
    assert sizes[0] == sizes[1] > 40
