"""BLAKE2b with a digest of eight bytes as plain SQL, for messages of at most one block."""

from __future__ import annotations

# Fixed values of the hash function (RFC 7693): start values and the order of words by round.
START = (
    0x6A09E667F3BCC908, 0xBB67AE8584CAA73B, 0x3C6EF372FE94F82B, 0xA54FF53A5F1D36F1,
    0x510E527FADE682D1, 0x9B05688C2B3E6C1F, 0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179,
)
ORDER = (
    (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15),
    (14, 10, 4, 8, 9, 15, 13, 6, 1, 12, 0, 2, 11, 7, 5, 3),
    (11, 8, 12, 0, 5, 2, 15, 13, 10, 14, 3, 6, 7, 1, 9, 4),
    (7, 9, 3, 1, 13, 12, 11, 14, 2, 6, 5, 10, 4, 0, 15, 8),
    (9, 0, 5, 7, 2, 4, 10, 15, 14, 1, 11, 12, 6, 8, 3, 13),
    (2, 12, 6, 10, 0, 11, 8, 3, 4, 13, 7, 5, 15, 14, 1, 9),
    (12, 5, 1, 15, 14, 13, 4, 10, 0, 7, 6, 3, 9, 2, 8, 11),
    (13, 11, 7, 14, 12, 1, 3, 9, 5, 0, 15, 4, 8, 6, 2, 10),
    (6, 15, 14, 9, 11, 3, 0, 8, 12, 2, 13, 7, 1, 4, 10, 5),
    (10, 2, 8, 4, 7, 6, 1, 5, 15, 11, 9, 14, 3, 12, 13, 0),
)
COLUMNS = ((0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15))
DIAGONALS = ((0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14))
ROUNDS, DIGEST = 12, 8
_ALL = "18446744073709551615::HUGEINT"


def _turned(x: str, bits: int) -> str:
    return f"((({x}) >> {bits}) | ((({x}) << {64 - bits}) & {_ALL}))"


def _sum(*terms: str) -> str:
    return f"(({' + '.join(terms)}) & {_ALL})"


def _steps() -> list[list[str]]:
    """Replaced columns of one step after the other; those of a step do not read each other."""
    steps = []
    for number in range(ROUNDS):
        order = ORDER[number % len(ORDER)]
        for half, quads in enumerate((COLUMNS, DIAGONALS)):
            for second in (0, 1):
                one, two = ((32, 24), (16, 63))[second]
                first_part, second_part = [], []
                for n, (a, b, c, d) in enumerate(quads):
                    word = f"m{order[8 * half + 2 * n + second]}"
                    added = _sum(f"v{a}", f"v{b}", word)
                    first_part += [f"{added} AS v{a}", f"{_turned(f'xor(v{d}, {added})', one)} AS v{d}"]
                    moved = _sum(f"v{c}", f"v{d}")
                    second_part += [f"{moved} AS v{c}", f"{_turned(f'xor(v{b}, {moved})', two)} AS v{b}"]
                steps += [first_part, second_part]
    return steps


def blake2b(source: str, column: str, out: str) -> str:
    """CTEs that end in ``out`` (column, code): the digest as a little-endian number.

    ``source`` has a row per message in ``column``, a text. A longer one than a block is an error.
    """
    size = f"octet_length(encode({column}))"
    words = ", ".join(
        "CAST(concat('0x', "
        + ", ".join(f"substr(h, {16 * i + 2 * byte + 1}, 2)" for byte in range(7, -1, -1))
        + f") AS UBIGINT)::HUGEINT AS m{i}"
        for i in range(16)
    )
    start = list(START[:8]) + list(START[:8])
    start[0] ^= 0x01010000 ^ DIGEST
    start[14] ^= (1 << 64) - 1
    values = [f"{v}::HUGEINT" for v in start]
    values[12] = f"xor({values[12]}, {size}::HUGEINT)"
    ctes = [
        f"{out}_0 AS (SELECT {column}, {words}, "
        + ", ".join(f"{value} AS v{i}" for i, value in enumerate(values))
        + f" FROM (SELECT {column}, CASE WHEN {size} > 128 THEN error('longer than a block') "
        f"ELSE rpad(hex(encode({column})), 256, '0') END AS h FROM {source}))"
    ]
    steps = _steps()
    for i, step in enumerate(steps):
        kept = " MATERIALIZED" if i % 8 == 7 else ""
        ctes.append(f"{out}_{i + 1} AS{kept} (SELECT * REPLACE ({', '.join(step)}) FROM {out}_{i})")
    first = START[0] ^ 0x01010000 ^ DIGEST
    ctes.append(
        f"{out} AS (SELECT {column}, xor(xor({first}::HUGEINT, v0), v8)::UBIGINT AS code "
        f"FROM {out}_{len(steps)})"
    )
    return ",\n".join(ctes)
