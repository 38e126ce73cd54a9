"""Properties over generated inputs."""

import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from luxtrace.functions import signing
from luxtrace.functions.keccak import inclusion_proof, merkle_levels, verify_proof
from luxtrace.operators.raster import kernels as K

digests = st.lists(st.integers(0, 40).map(lambda i: hashlib.sha256(bytes([i])).digest()), min_size=1, max_size=20)


@given(digests)
@settings(max_examples=60, deadline=None)
def test_every_leaf_has_a_proof(leaves):
    levels = merkle_levels(leaves)
    assert all(verify_proof(x, inclusion_proof(levels, x), levels[-1][0]) for x in leaves)
    assert levels[-1] == merkle_levels(leaves[::-1])[-1]


@given(st.binary(max_size=80), st.integers(1, 2**200))
@settings(max_examples=8, deadline=None)
def test_signers_are_recovered(message, key):
    raw = key.to_bytes(32, "big")
    assert signing.recover(message, signing.sign(message, raw)) == signing.address_of(raw)


@given(st.integers(1, 60), st.integers(1, 60), st.integers(0, 99))
@settings(max_examples=30, deadline=None)
def test_wavelets_invert(h, w, seed):
    a = np.random.default_rng(seed).normal(size=(h, w))
    low, details = K.decompose(a)
    assert np.allclose(K.recompose(low, details)[:h, :w], a, atol=1e-9)


@given(st.integers(2, 40), st.integers(2, 40), st.integers(1, 30), st.integers(1, 30))
@settings(max_examples=40, deadline=None)
def test_resizing_keeps_flat_fields(h, w, oh, ow):
    assert np.allclose(K.area_resize(np.full((h, w), 0.25, np.float32), ow, oh), 0.25)
    assert (K.lanczos_resize(np.full((h, w), 77, np.uint8), ow, oh) == 77).all()
