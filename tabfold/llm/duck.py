"""Pieces of DuckDB SQL for functions that engine lacks."""

#: A row with the table of the checksum, made bit by bit from its polynomial; to be joined under any alias.
CRC_TABLE = (
    "(SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i::BIGINT, range(8)),"
    " lambda c, k: xor(c >> 1, 3988292384 * (c & 1)))) AS crc_table)"
)


def crc32(text: str) -> str:
    """The unsigned crc32 of the UTF-8 bytes of a text column; ``CRC_TABLE`` must be among the tables read."""
    pairs = f"list_transform(range(1, 2 * strlen({text}), 2), lambda i: ('0x' || substr(hex(encode({text})), i, 2))::BIGINT)"
    return (
        f"xor(4294967295, list_reduce(list_prepend(4294967295, {pairs}),"
        " lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1])))"
    )


def base32(digits: str) -> str:
    """Upper-case base32 of a text of hexadecimal digits, a multiple of five of them."""
    return (
        f"list_reduce(list_prepend('', list_transform(range(0, length({digits}) // 5 * 4), lambda i:"
        f" substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',"
        f" (((('0x' || substr({digits}, i // 4 * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1)::BIGINT, 1))),"
        " lambda a, b: a || b)"
    )
