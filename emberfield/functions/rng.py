"""Reproducible noise from keys.

A random number is a function of (row key, seed, draw), not of the task that makes it. A retried
task, another partitioning or another engine gives the same numbers, and the numpy twins give
the same numbers to vectorised workers.

Each key is digested once into 32-bit words. Draw ``d`` then takes word + d * step and scrambles
it with two xor-shift-multiply rounds, all in 64-bit arithmetic that cannot overflow.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = 0xFFFFFFFF
STEP = 0x9E3779B9
MULTIPLIER = 0x45D9F3B
WORDS = ("a", "b", "c")


def noise_words(*key: Column, seed: int = 0) -> Column:
    """Struct of three 32-bit words (a, b, c) for a row key."""
    text = F.concat_ws(":", *[F.coalesce(k.cast("string"), F.lit("NA")) for k in key], F.lit(str(seed)))
    digest = F.md5(text.cast("binary"))
    return F.struct(
        *[
            F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint").alias(name)
            for i, name in enumerate(WORDS)
        ]
    )


def _scramble(x: Column) -> Column:
    for _ in range(2):
        x = x.bitwiseXOR(F.shiftright(x, 16))
        x = (x * F.lit(MULTIPLIER)).bitwiseAND(F.lit(MASK))
    return x.bitwiseXOR(F.shiftright(x, 16))


def uniform(word: Column, draw: Column) -> Column:
    """Number in (0, 1)."""
    x = (word + draw.cast("bigint") * F.lit(STEP)).bitwiseAND(F.lit(MASK))
    return (_scramble(x).cast("double") + F.lit(0.5)) / F.lit(float(2**32))


def standard_normal(words: Column, draw: Column) -> Column:
    u, v = uniform(words["a"], draw), uniform(words["b"], draw)
    return F.sqrt(F.lit(-2.0) * F.log(u)) * F.cos(F.lit(2 * np.pi) * v)


def student_t(words: Column, draw: Column, nu: Column) -> Column:
    """Student-t noise for any degrees of freedom, by the polar form of Bailey (1994)."""
    u, v = uniform(words["a"], draw), uniform(words["b"], draw)
    radius = nu * (F.pow(u, F.lit(-2.0) / nu) - F.lit(1.0))
    return F.sqrt(radius) * F.cos(F.lit(2 * np.pi) * v)


def uniform_np(word: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """numpy twin of :func:`uniform`: rows of ``word`` by columns of ``draw``."""
    mask, shift, factor = np.uint64(MASK), np.uint64(16), np.uint64(MULTIPLIER)
    x = (word.astype(np.uint64)[:, None] + draw.astype(np.uint64)[None, :] * np.uint64(STEP)) & mask
    for _ in range(2):
        x ^= x >> shift
        x *= factor
        x &= mask
    x ^= x >> shift
    return (x.astype(np.float64) + 0.5) / float(2**32)


def standard_normal_np(a: np.ndarray, b: np.ndarray, draw: np.ndarray) -> np.ndarray:
    return np.sqrt(-2.0 * np.log(uniform_np(a, draw))) * np.cos(2 * np.pi * uniform_np(b, draw))


def student_t_np(a: np.ndarray, b: np.ndarray, draw: np.ndarray, nu: np.ndarray) -> np.ndarray:
    radius = nu[None, :] * (uniform_np(a, draw) ** (-2.0 / nu[None, :]) - 1.0)
    return np.sqrt(radius) * np.cos(2 * np.pi * uniform_np(b, draw))
