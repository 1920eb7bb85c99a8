"""Token identifiers and token-account bytes."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Namespace of token identifiers, address alphabet, account layout.
NAMESPACE_HEX = "6ba7b8119dad11d180b400c04fd430c8"
ALPHABET = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
ACCOUNT_BYTES = 72

TEN_DIGITS = 58**10


def token_uuid(mint: Column) -> Column:
    """Name-based (version 5) identifier of a mint."""
    name = F.concat(F.unhex(F.lit(NAMESPACE_HEX)), F.encode(mint, "UTF-8"))
    digest = F.sha1(name)
    variant = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(F.lower(F.hex(variant)), F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )


@F.arrow_udf(StringType())
def base58(keys: pa.Array) -> pa.Array:
    """Base58 text of a key.  Leading zero bytes add nothing; an all-zero key is '1'.

    Mints and owners repeat, so each key of a batch is encoded once.
    """

    def encode(key: bytes) -> str:
        number, digits = int.from_bytes(key, "big"), []
        while number:
            # Ten digits per division of the long number.
            number, chunk = divmod(number, TEN_DIGITS)
            for _ in range(10):
                chunk, digit = divmod(chunk, 58)
                digits.append(ALPHABET[digit])
        return "".join(reversed(digits)).lstrip(ALPHABET[0]) or ALPHABET[0]

    coded = keys.dictionary_encode()
    texts = [encode(key) for key in coded.dictionary.to_pylist()]
    return pa.array(texts, pa.string()).take(coded.indices)


def decode_account(encoded: Column) -> Column:
    """Mint key, owner key and balance of base64 account bytes; null when fewer than 72 bytes.

    The balance is an unsigned 64-bit little-endian number and does not fit Spark's signed long.
    """
    data = F.try_to_binary(encoded, F.lit("base64"))
    little_endian = F.hex(F.substring(data, 65, 8))
    big_endian = F.concat(*[F.substring(little_endian, i, 2) for i in range(15, 0, -2)])
    return F.when(
        F.length(data) >= ACCOUNT_BYTES,
        F.struct(
            F.substring(data, 1, 32).alias("mint_key"),
            F.substring(data, 33, 32).alias("owner_key"),
            F.conv(big_endian, 16, 10).cast("decimal(20,0)").alias("balance"),
        ),
    )
