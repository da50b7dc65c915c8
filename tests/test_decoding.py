import itertools
import math

from quillspark.functions.bidi import visual_order
from quillspark.operators import decoding


def collapse(path):
    return tuple(c for i, c in enumerate(path) if c and (i == 0 or c != path[i - 1]))


def test_beam_search_sums_all_paths():
    frames = [[math.log(p) for p in row] for row in ([0.5, 0.3, 0.2], [0.2, 0.5, 0.3], [0.4, 0.4, 0.2], [0.1, 0.2, 0.7])]
    want = {}
    for path in itertools.product(range(3), repeat=4):
        k = collapse(path)
        want[k] = want.get(k, 0.0) + math.exp(sum(f[c] for f, c in zip(frames, path)))
    got = decoding.prefix_beam_search(frames, beam=1000)
    assert {k: round(math.exp(v), 12) for k, v in got} == {k: round(v, 12) for k, v in want.items()}
    assert [v for _, v in got] == sorted((v for _, v in got), reverse=True)
    assert len(decoding.prefix_beam_search(frames, beam=2)) == 2 and decoding.prefix_beam_search([]) == [((), 0.0)]


def test_beam_search_rows(spark):
    d = spark.createDataFrame([(1, [[-0.1, -3.0], [-3.0, -0.1]]), (2, None), (3, [])], "id int, frames array<array<double>>")
    got = [(r.id, r["rank"], list(r.indices)) for r in decoding.beam_search(d, "id", "frames", beam=2).collect()]
    assert got == [(1, 0, [1]), (1, 1, []), (3, 0, [])]


def test_visual_order():
    assert visual_order("hello (1)") == "hello (1)"
    assert visual_order("שלום") == "םולש"
    assert visual_order("abc שלום def") == "abc םולש def"
    assert visual_order("שלום 123") == "123 םולש"
    assert visual_order("سلام abc") == "abc مالس"
    assert visual_order("(א)") == "(א)"
    assert visual_order("") == ""


def test_equal_prefixes_go_by_symbols():
    """Paths of one probability, summed in different orders, differ in their last bits; that isn't an order."""
    rows = [[0.1, 0.2, 0.2, 0.3], [0.3, 0.1, 0.1, 0.7], [0.2, 0.3, 0.3, 0.1], [0.7, 0.1, 0.1, 0.3], [0.1, 0.6, 0.6, 0.2], [0.3, 0.7, 0.7, 0.1]]
    got = decoding.prefix_beam_search([[math.log(p) for p in r] for r in rows], beam=8)
    assert len(got) == 8 and [k for k, _ in got] == [k for k, _ in sorted(got, key=lambda x: (-round(x[1], 9), x[0]))]
    frame = [[math.log(p) for p in (0.2, 0.4, 0.4)]]
    near = [[frame[0][0], frame[0][1], frame[0][2] + 1e-13]]  # symbol 2 is above by a last bit only
    assert [k for k, _ in decoding.prefix_beam_search(near, beam=2)] == [(1,), (2,)]
