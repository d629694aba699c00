import numpy as np
import pytest

from spectraloom.sources import numpress as npr


@pytest.mark.parametrize("n", [0, 1, 2, 3, 50, 1001])
def test_round_trip(n):
    r = np.random.default_rng(n)
    v = np.sort(r.uniform(100, 2000, n))
    assert np.abs(npr.decode_linear(npr.encode_linear(v)) - v).max(initial=0) <= 5.1e-6
    w = r.integers(0, 10**6, n) * (r.random(n) < 0.7)
    assert npr.decode_pic(npr.encode_pic(w)).tolist() == w.tolist()
    back = npr.decode_slof(npr.encode_slof(w))
    assert np.abs(np.log1p(back) - np.log1p(w)).max(initial=0) < 2e-4


def test_half_bytes():
    # by hand: head (zeros left out, or 8 + ones left out), then half bytes from the lowest on
    cases = {0: [8], 1: [7, 1], 255: [6, 15, 15], 0x1234: [4, 4, 3, 2, 1], -1: [15, 15], -16: [15, 0], -17: [14, 15, 14], 2**31 - 1: [0, 15, 15, 15, 15, 15, 15, 15, 7], -(2**31): [0, 0, 0, 0, 0, 0, 0, 0, 8]}
    for x, half in cases.items():
        half = half + [0] * (len(half) % 2)
        assert list(npr._packed([x])) == [a << 4 | b for a, b in zip(half[0::2], half[1::2])], x
    assert npr._ints(npr._packed(list(cases))) == list(cases)
    with pytest.raises(ValueError):
        npr._packed([1 << 31])
    with pytest.raises(ValueError):
        npr._ints(bytes([0x11]))


def test_linear_by_hand():
    scale = np.array([2.0], ">f8").tobytes()
    # 1.5, 2.0, 2.5 on the line, then 4.0: 2 above it in steps of a half
    data = scale + np.array([3, 4], "<i4").tobytes() + npr._packed([0, 2])
    assert npr.decode_linear(data).tolist() == [1.5, 2.0, 2.5, 4.0]
