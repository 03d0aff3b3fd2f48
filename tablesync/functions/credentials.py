"""Encryption of stored credentials, alone and inside job descriptions.

ECB without an initial vector is weak encryption. It is what the stored values use, so it is
kept for reading and writing them; it is no recommendation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

CREDENTIAL_KEYS = ("username", "password")


def derive_key(seed: str) -> bytes:
    """128-bit key of a seed: the first 16 bytes of SHA-1 applied twice."""
    return hashlib.sha1(hashlib.sha1(seed.encode()).digest()).digest()[:16]


def _key(seed: str) -> Column:
    return F.unhex(F.lit(derive_key(seed).hex()))


def encrypt(value: Column, seed: str) -> Column:
    return F.base64(F.aes_encrypt(value.cast("binary"), _key(seed), F.lit("ECB"), F.lit("PKCS")))


def decrypt(value: Column, seed: str) -> Column:
    """Clear text, or null where the value is not a cipher text of this key."""
    cipher = F.try_to_binary(value, F.lit("base64"))
    return F.try_aes_decrypt(cipher, _key(seed), F.lit("ECB"), F.lit("PKCS")).cast("string")


def ensure_encrypted(value: Column, seed: str) -> Column:
    """The value itself where it already is a cipher text, else its cipher text."""
    return F.when(decrypt(value, seed).isNull(), encrypt(value, seed)).otherwise(value)


def _fields(value: Column) -> Column:
    return value.cast("map<string,variant>")


def _with(fields: Column, **new: Column) -> Column:
    """A JSON object with some fields replaced."""
    pairs = [part for name, value in new.items() for part in (F.lit(name), value)]
    return F.to_variant_object(F.map_concat(F.map_filter(fields, lambda k, _: ~k.isin(*new)), F.create_map(*pairs)))


def change_credentials(job_json: Column, change: Callable[[Column], Column]) -> Column:
    """Job text with ``change`` applied to the user name and password of every reader and writer.

    Where ``change`` gives null the stored value stays; all other values are unchanged. The
    text is parsed into a variant, opened level by level, each level once, and rebuilt.
    """

    def credential(key, value):
        new = change(F.try_variant_get(value, "$", "string")).cast("variant")
        return F.when(key.isin(*CREDENTIAL_KEYS), F.coalesce(new, value)).otherwise(value)

    def changed(side):
        return F.to_variant_object(F.transform_values(_fields(side["parameter"]), credential))

    def open_sides(content):
        return F.struct(content.alias("all"), _fields(content["reader"]).alias("reader"), _fields(content["writer"]).alias("writer"))

    def rebuild(content):
        reader, writer = content["reader"], content["writer"]
        return _with(content["all"], reader=_with(reader, parameter=changed(reader)), writer=_with(writer, parameter=changed(writer)))

    def rebuild_job(job):
        contents = F.transform(F.transform(job["content"].cast("array<variant>"), _fields), open_sides)
        return _with(job, content=F.to_variant_object(F.transform(contents, rebuild)))

    def rebuild_document(document):
        return _with(document, job=F.get(F.transform(F.array(_fields(document["job"])), rebuild_job), F.lit(0)))

    # One-element arrays bind a parsed level to a name, so that it is not parsed per use.
    return F.to_json(F.get(F.transform(F.array(_fields(F.try_parse_json(job_json))), rebuild_document), F.lit(0)))


def encrypt_job(job_json: Column, seed: str) -> Column:
    return change_credentials(job_json, lambda v: encrypt(v, seed))


def decrypt_job(job_json: Column, seed: str) -> Column:
    return change_credentials(job_json, lambda v: decrypt(v, seed))
