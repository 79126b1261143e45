"""The CRC-32 of a text's UTF-8 bytes in SQL, for engines that have no such function."""

#: Fixed value: the reflected polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320
ONES = 0xFFFFFFFF


def crc_table_sql() -> str:
    """A common table expression ``crc_table`` of one row: the 256 steps ``crc_steps``."""
    step = f"lambda c, i: CASE WHEN c & 1 = 1 THEN xor({POLYNOMIAL}, c >> 1) ELSE c >> 1 END"
    return f"crc_table AS (SELECT list(v ORDER BY k) AS crc_steps FROM (SELECT k, list_reduce([CAST(k AS BIGINT), 1, 2, 3, 4, 5, 6, 7, 8], {step}) AS v FROM range(0, 256) r(k)))"


def crc32_sql(text: str) -> str:
    """The CRC-32 of an expression; ``crc_table`` must be joined."""
    digits = "'0123456789ABCDEF'"
    return (
        f"xor(list_reduce(list_prepend(CAST({ONES} AS BIGINT), list_transform(range(1, CAST(length(hex({text})) AS BIGINT), 2), "
        f"lambda p: CAST(16 * (strpos({digits}, substr(hex({text}), p, 1)) - 1) + strpos({digits}, substr(hex({text}), p + 1, 1)) - 1 AS BIGINT))), "
        f"lambda c, b: xor(crc_steps[(xor(c, b) & 255) + 1], c >> 8)), {ONES})"
    )
