"""A vault of reversible tokens: a Parquet table of token, ciphertext, type and time.

Tokens are keyed hashes of the values, so that a value has one token everywhere. Ciphertexts are
AES-GCM under the hash of a key given by the caller. Only tokens that the table lacks are added; two
writers at once may both add one, whose rows then stand for the same value.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwright.operators.sanitize import vault_token

SCHEMA = "token string, ciphertext binary, pii_type string, created_at timestamp"


def _key(key: str) -> Column:
    return F.lit(bytearray(hashlib.sha256(key.encode()).digest()))


class TokenVault:
    def __init__(self, spark: SparkSession, path: str, key: str, salt: str):
        if not key or not salt:
            raise ValueError("a vault needs a key and a salt")
        self.spark, self.path, self.key, self.salt = spark, path, key, salt

    def table(self) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def tokenize(self, values: DataFrame, value: str = "value", kind: str = "type") -> DataFrame:
        """Adds `token`; values that are new to the vault are appended to it."""
        made = values.withColumn("token", vault_token(F.col(value), F.col(kind), self.salt))
        rows = made.filter(F.col(value).isNotNull()).groupBy("token").agg(F.min(F.struct(F.col(kind).alias("pii_type"), F.col(value).alias("v"))).alias("x"))
        fresh = rows.join(self.table().select("token"), "token", "left_anti")
        fresh.select("token", F.aes_encrypt(F.encode("x.v", "UTF-8"), _key(self.key), F.lit("GCM")).alias("ciphertext"), F.col("x.pii_type").alias("pii_type"), F.current_timestamp().alias("created_at")).write.mode("append").parquet(self.path)
        return made

    def detokenize(self, tokens: DataFrame, token: str = "token") -> DataFrame:
        """Adds `value`: null for an unknown token or under a wrong key."""
        wanted = tokens.select(F.col(token).alias("token")).distinct()
        known = self.table().join(wanted, "token", "left_semi").groupBy(F.col("token").alias("_t")).agg(F.min("ciphertext").alias("ciphertext"))
        plain = F.try_aes_decrypt(F.col("ciphertext"), _key(self.key), F.lit("GCM")).cast("string")
        return tokens.join(known, F.col(token) == F.col("_t"), "left").withColumn("value", plain).drop("_t", "ciphertext")
