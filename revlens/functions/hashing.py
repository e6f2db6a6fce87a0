"""Hash functions as native Column expressions.

All of them run inside whole-stage codegen; no Python UDF is involved.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUL = "\x00"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def location_hash(repo, path, symbol, category) -> Column:
    """H1: hex sha256 of repo, path, symbol, category joined by NUL bytes.

    ``concat_ws`` skips NULLs, so every field is coalesced to '' first; an empty
    symbol is a valid input (file-level findings).
    """
    parts = [F.coalesce(_c(x).cast("string"), F.lit("")) for x in (repo, path, symbol, category)]
    return F.sha2(F.concat_ws(NUL, *parts), 256)


def packed(text) -> Column:
    """Any text as a key that is never null; a sha256 in hex takes 33 bytes instead of 64, an md5 17 instead of 32."""
    t = _c(text)
    return F.coalesce(F.when(t.rlike("^(?:[0-9a-f]{32}){1,2}\\z"), F.concat(F.lit(b"h"), F.unhex(t)))
                      .otherwise(F.concat(F.lit(b"t"), t.cast("binary"))), F.lit(b"n"))


def unpacked(key) -> Column:
    """The text of a ``packed`` key."""
    k = _c(key)
    rest, kind = F.substring(k, 2, 2**31 - 1), F.substring(k, 1, 1)
    return F.when(kind == F.lit(b"h"), F.lower(F.hex(rest))).when(kind == F.lit(b"t"), rest.cast("string"))


def normalise_code(text) -> Column:
    """Whitespace-normalised code region: runs of blanks collapse, ends trimmed."""
    # a single blank is left as it is: most are
    return F.trim(F.regexp_replace(_c(text), r"\s{2,}|[^\S ]", " "))


def content_hash(text) -> Column:
    """H2: sha256 of the normalised code region; NULL when there is no region."""
    return hash_of_code(normalise_code(text))


def hash_of_code(norm: Column) -> Column:
    """``content_hash`` of a region that is normalised."""
    return F.when(F.coalesce(norm, F.lit("")) == "", F.lit(None).cast("string")) \
        .otherwise(F.sha2(norm, 256))


def prompt_hash(text) -> Column:
    """H27: 'sha256:' + hex digest of the assembled prompt."""
    return F.concat(F.lit("sha256:"), F.sha2(_c(text), 256))


def config_hash(*fields: str) -> Column:
    """sha256 of the JSON object of the fields, keys in sorted order."""
    return F.sha2(F.to_json(F.struct(*sorted(fields))), 256)


def hmac_sha256_hex(payload, key: str) -> Column:
    """HMAC-SHA256(key, payload) in hex, built from sha2/unhex only.

    HMAC = H((K ^ opad) || H((K ^ ipad) || m)); the padded keys are constants
    computed once on the driver from the (small) secret, so the per-row work is
    two native sha2 calls.
    """
    import hashlib

    block = 64
    k = key.encode("utf-8")
    if len(k) > block:
        k = hashlib.sha256(k).digest()
    k = k.ljust(block, b"\x00")
    ipad = bytes(b ^ 0x36 for b in k).hex()
    opad = bytes(b ^ 0x5C for b in k).hex()
    inner = F.unhex(F.sha2(F.concat(F.unhex(F.lit(ipad)), _c(payload).cast("binary")), 256))
    return F.sha2(F.concat(F.unhex(F.lit(opad)), inner), 256)


def signature_ok(payload, header, key: str) -> Column:
    """A3: header must be 'sha256=' + hex HMAC of the raw payload."""
    expected = F.concat(F.lit("sha256="), hmac_sha256_hex(payload, key))
    return F.coalesce(_c(header) == expected, F.lit(False))
