"""Checks of numbers made from order keys, with the SQL that states them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwright.functions import fixed as X
from veilwright.functions import validators as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet")



def _digits(n: int) -> Column:
    return F.lpad(((F.col("o_orderkey") * 7919 + 12345) * 104729 % 10**n).cast("string"), n, "0")


def _digits_sql(n: int) -> str:
    return f"lpad(CAST((o_orderkey * 7919 + 12345) * 104729 % {10**n} AS VARCHAR), {n}, '0')"


def digit(i: int) -> str:
    return f"CAST(v[{i + 1}] AS INTEGER)"


def number(i: int, k: int) -> str:
    return f"CAST(substr(v, {i + 1}, {k}) AS BIGINT)"


def weighted(weights, start: int = 0) -> str:
    return "(" + " + ".join(f"{digit(start + i)} * {w}" for i, w in enumerate(weights)) + ")"


def real_date(year: str, month: str, day: str) -> str:
    return f"try_strptime(lpad(CAST({year} AS VARCHAR), 4, '0') || lpad(CAST({month} AS VARCHAR), 2, '0') || lpad(CAST({day} AS VARCHAR), 2, '0'), '%Y%m%d') IS NOT NULL"


def luhn(v: str) -> str:
    return f"list_sum(list_transform(range(1, length({v}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(({v})[-i] AS INTEGER) ELSE CAST(({v})[-i] AS INTEGER) * 2 - CASE WHEN CAST(({v})[-i] AS INTEGER) > 4 THEN 9 ELSE 0 END END)) % 10 = 0"


_LOW = lambda r: f"(CASE WHEN {r} < 2 THEN 0 ELSE 11 - {r} END)"
_EITHER = f"({real_date(f'1900 + {number(0, 2)}', number(2, 2), number(4, 2))} OR {real_date(f'2000 + {number(0, 2)}', number(2, 2), number(4, 2))})"
_VARIED = "len(list_distinct(string_split(v, ''))) > 1"


def iso_fold(size: int) -> str:
    """The rest of ISO 7064 MOD 11,10 over so many digits."""
    return f"list_reduce([10] || list_transform(range(1, {size + 1}), lambda i: CAST(v[i] AS INTEGER)), lambda p, x: ((CASE WHEN (p + x) % 10 = 0 THEN 10 ELSE (p + x) % 10 END) * 2) % 11)"


_FOLD = iso_fold(10)
_VERHOEFF_D = "[" + ", ".join("[" + ", ".join(map(str, r)) + "]" for r in X.VERHOEFF_D) + "]"
_VERHOEFF_P = "[" + ", ".join("[" + ", ".join(map(str, r)) + "]" for r in X.VERHOEFF_P) + "]"
_PESEL_MONTH = f"({number(2, 2)} % 20)"
_PESEL_YEAR = f"([1900, 2000, 2100, 2200, 1800][{number(2, 2)} // 20 + 1] + {number(0, 2)})"
_CNP_YEAR = f"(CASE WHEN {digit(0)} IN (3, 4, 9) THEN 1800 WHEN {digit(0)} IN (5, 6) THEN 2000 ELSE 1900 END + {number(1, 2)})"
_KR_YEAR = f"(CASE WHEN {digit(6)} IN (1, 2, 5, 6) THEN 1900 ELSE 2000 END + {number(0, 2)})"
_DAY = lambda day, month: real_date("2000", month, day)

#: (check, digits, SQL condition on v, a string of so many digits)
NUMBERS = {
    "tr_national_id": (V.is_valid_tr_national_id, 11, f"v[1] <> '0' AND (({digit(0)} + {digit(2)} + {digit(4)} + {digit(6)} + {digit(8)}) * 7 - ({digit(1)} + {digit(3)} + {digit(5)} + {digit(7)}) + 1000) % 10 = {digit(9)} AND {weighted((1,) * 10)} % 10 = {digit(10)}"),
    "luhn": (V.is_valid_luhn, 16, f"{_VARIED} AND {luhn('v')}"),
    "pesel": (V.is_valid_pesel, 11, f"{number(2, 2)} // 20 <= 4 AND {real_date(_PESEL_YEAR, _PESEL_MONTH, number(4, 2))} AND (10 - {weighted(X.PESEL_WEIGHTS)} % 10) % 10 = {digit(10)}"),
    "ssn": (V.is_valid_ssn, 9, "left(v, 3) NOT IN ('000', '666') AND v[1] <> '9' AND substr(v, 4, 2) <> '00' AND substr(v, 6, 4) <> '0000'"),
    "cpf": (V.is_valid_cpf, 11, f"{_VARIED} AND {_LOW(f'({weighted(X.CPF_WEIGHTS[0])} % 11)')} = {digit(9)} AND {_LOW(f'({weighted(X.CPF_WEIGHTS[1])} % 11)')} = {digit(10)}"),
    "de_idnr": (V.is_valid_de_idnr, 11, f"v[1] <> '0' AND {_VARIED} AND (CASE WHEN {_FOLD} = 1 THEN 0 ELSE 11 - {_FOLD} END) = {digit(10)}"),
    "bsn": (V.is_valid_bsn, 9, f"{_VARIED} AND {weighted(X.BSN_WEIGHTS)} % 11 = 0"),
    "be_national": (V.is_valid_be_national, 11, f"{_VARIED} AND {_EITHER} AND {number(9, 2)} IN (97 - {number(0, 9)} % 97, 97 - (2000000000 + {number(0, 9)}) % 97)"),
    "se_pnr": (V.is_valid_se_pnr, 10, f"{_VARIED} AND {_DAY(f'(CASE WHEN {number(4, 2)} > 60 THEN {number(4, 2)} - 60 ELSE {number(4, 2)} END)', number(2, 2))} AND {luhn('v')}"),
    "no_fnr": (V.is_valid_no_fnr, 11, f"{_VARIED} AND {_DAY(number(0, 2), number(2, 2))} AND (11 - {weighted(X.NO_WEIGHTS[0])} % 11) % 11 = {digit(9)} AND (11 - {weighted(X.NO_WEIGHTS[1])} % 11) % 11 = {digit(10)}"),
    "pt_nif": (V.is_valid_pt_nif, 9, f"v[1] <> '0' AND {_VARIED} AND {_LOW(f'({weighted(X.PT_WEIGHTS)} % 11)')} = {digit(8)}"),
    "ro_cnp": (V.is_valid_ro_cnp, 13, f"v[1] <> '0' AND {_VARIED} AND {real_date(_CNP_YEAR, number(3, 2), number(5, 2))} AND {number(7, 2)} BETWEEN 1 AND 52 AND {number(9, 3)} > 0 AND (CASE WHEN {weighted(X.CNP_WEIGHTS)} % 11 = 10 THEN 1 ELSE {weighted(X.CNP_WEIGHTS)} % 11 END) = {digit(12)}"),
    "gr_afm": (V.is_valid_gr_afm, 9, f"v[1] <> '0' AND {_VARIED} AND {weighted(X.AFM_WEIGHTS)} % 11 % 10 = {digit(8)}"),
    "aba": (V.is_valid_aba, 9, f"{_VARIED} AND ({number(0, 2)} <= 12 OR {number(0, 2)} BETWEEN 21 AND 32 OR {number(0, 2)} BETWEEN 61 AND 72 OR {number(0, 2)} = 80) AND {weighted(X.ABA_WEIGHTS)} % 10 = 0"),
    "itin": (V.is_valid_itin, 9, f"v[1] = '9' AND {_VARIED} AND {number(3, 2)} >= 70 AND {number(3, 2)} NOT IN (89, 93)"),
    "abn": (V.is_valid_abn, 11, f"v[1] <> '0' AND {_VARIED} AND ({weighted(X.ABN_WEIGHTS)} - 10) % 89 = 0"),
    "kr_rrn": (V.is_valid_kr_rrn, 13, f"{_VARIED} AND {digit(6)} BETWEEN 1 AND 8 AND {real_date(_KR_YEAR, number(2, 2), number(4, 2))} AND (11 - {weighted(X.KR_WEIGHTS)} % 11) % 10 = {digit(12)}"),
    "il_id": (V.is_valid_il_id, 8, f"{_VARIED} AND {luhn('v')}"),
    "za_id": (V.is_valid_za_id, 13, f"{_VARIED} AND {_EITHER} AND {digit(10)} < 2 AND {luhn('v')}"),
    "th_id": (V.is_valid_th_id, 13, f"v[1] NOT IN ('0', '9') AND {_VARIED} AND (11 - {weighted(X.TH_WEIGHTS)} % 11) % 10 = {digit(12)}"),
    "jp_number": (V.is_valid_jp_number, 12, f"{_VARIED} AND {_LOW(f'({weighted(X.JP_WEIGHTS)} % 11)')} = {digit(11)}"),
    "imei": (V.is_valid_imei, 15, f"{_VARIED} AND {luhn('v')}"),
    "vkn": (V.is_valid_vkn, 10, f"v[1] <> '0' AND {_VARIED} AND (10 - (" + " + ".join(f"(({digit(i)} + {9 - i}) % 10 * {2 ** (9 - i) % 11}) % 11" for i in range(9)) + f") % 10) % 10 = {digit(9)}"),
    "tfn": (V.is_valid_tfn, 9, f"{_VARIED} AND {weighted(X.TFN_WEIGHTS)} % 11 = 0"),
    "sin": (V.is_valid_sin, 9, f"v[1] NOT IN ('0', '8', '9') AND {_VARIED} AND {luhn('v')}"),
    "aadhaar": (V.is_valid_aadhaar, 12, f"v[1] NOT IN ('0', '1') AND {_VARIED} AND list_reduce([0] || list_transform(range(0, 12), lambda i: {_VERHOEFF_P}[i % 8 + 1][CAST(v[-i - 1] AS INTEGER) + 1]), lambda c, x: {_VERHOEFF_D}[c + 1][x + 1]) = 0"),
    "npi": (V.is_valid_npi, 10, f"v[1] IN ('1', '2') AND {_VARIED} AND {luhn(chr(39) + '80840' + chr(39) + ' || v')}"),
}


def _number_query(check, n: int) -> Callable[[SparkSession, str], DataFrame]:
    def made(spark: SparkSession, sf_dir: str) -> DataFrame:
        return read(spark, sf_dir).select("o_orderkey", _digits(n).alias("v")).filter(check(F.col("v")))

    return made


for _name, (_check, _size, _sql) in NUMBERS.items():
    QUERIES[f"valid_{_name}"] = _number_query(_check, _size)
    SQL[f"valid_{_name}"] = f"SELECT o_orderkey, v FROM (SELECT o_orderkey, {_digits_sql(_size)} AS v FROM orders) WHERE {_sql}"


SQL["valid_nif"] = f"SELECT o_orderkey, v FROM (SELECT o_orderkey, {_digits_sql(8)} || '{X.ES_LETTERS}'[CAST(o_orderkey % 23 + 1 AS INTEGER)] AS v FROM orders) WHERE '{X.ES_LETTERS}'[CAST(CAST(left(v, 8) AS BIGINT) % 23 + 1 AS INTEGER)] = v[9]"


def _nif(spark, sf_dir):
    made = F.concat(_digits(8), F.substring(F.lit(X.ES_LETTERS), (F.col("o_orderkey") % 23 + 1).cast("int"), F.lit(1)))
    return read(spark, sf_dir).select("o_orderkey", made.alias("v")).filter(V.is_valid_nif(F.col("v")))


SQL["valid_iban"] = f"SELECT o_orderkey, v FROM (SELECT o_orderkey, 'DE' || {_digits_sql(2)} || lpad({_digits_sql(15)}, 18, '0') AS v FROM orders) WHERE CAST(substr(v, 5) || '1314' || substr(v, 3, 2) AS HUGEINT) % 97 = 1"


def _iban(spark, sf_dir):
    made = F.concat(F.lit("DE"), _digits(2), F.lpad(_digits(15), 18, "0"))
    return read(spark, sf_dir).select("o_orderkey", made.alias("v")).filter(V.is_valid_iban(F.col("v")))


QUERIES |= {"valid_nif": _nif, "valid_iban": _iban}
