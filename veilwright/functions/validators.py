"""Checks of single values: each takes a string column and gives a boolean column, false for null.

They are written as SQL text (functions/sqltext.py), which detect() puts into one expression.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as PF
from pyspark.sql.types import BooleanType

from veilwright.functions import fixed as X
from veilwright.functions import sqltext as F
from veilwright.functions.columns import (
    no,
    chars,
    compact,
    constants,
    digit,
    digits_of,
    is_date,
    let,
    letter,
    letter_values,
    luhn,
    mod_11_10,
    number,
    numbers,
    only_digits,
    shaped,
    tidy,
    values_weighted,
    weighted,
)
from veilwright.functions.sqltext import Sql, on_columns


def _low(rest: Sql) -> Sql:
    """The check digit of many mod 11 schemes: 0 for a rest of 0 or 1, otherwise 11 less the rest."""
    return F.when(rest < 2, 0).otherwise(11 - rest)


@on_columns
def is_valid_tr_national_id(v: Sql) -> Sql:
    def check(d: Sql) -> Sql:
        # seven times the odd places less the even ones
        tenth = F.pmod(weighted(d, (7, -1, 7, -1, 7, -1, 7, -1, 7)), F.lit(10))
        return (tenth == digit(d, 9)) & (weighted(d, (1,) * 10) % 10 == digit(d, 10))

    return digits_of(v, 11, check, "1-9", vary=False)


@on_columns
def is_valid_luhn(v: Sql) -> Sql:
    return digits_of(v, (13, 19), luhn)


def pesel_date(d: Sql) -> tuple[Sql, Sql, Sql]:
    """Year, month and day of the digits; the month's tens tell the century."""
    month = number(d, 2, 2)
    step = F.floor(month / 20).cast("int")
    century = F.element_at(F.array(*map(F.lit, (1900, 2000, 2100, 2200, 1800))), F.least(step, F.lit(4)) + 1)
    return century + number(d, 0, 2), month - step * 20, number(d, 4, 2)


@on_columns
def extract_pesel_dob(v: Sql) -> Sql:
    """The date of birth, or null."""

    def made(d: Sql) -> Sql:
        year, month, day = pesel_date(d)
        return F.when(is_date(year, month, day), F.make_date(F.when(is_date(year, month, day), year).cast("int"), month.cast("int"), day.cast("int")))

    return let(only_digits(v), lambda d: F.when(F.rlike(d, F.lit("^[0-9]{11}$")), made(d)))


@on_columns
def is_valid_pesel(v: Sql) -> Sql:
    return digits_of(v, 11, lambda d: is_date(*pesel_date(d)) & ((10 - weighted(d, X.PESEL_WEIGHTS) % 10) % 10 == digit(d, 10)), vary=False)


@on_columns
def is_valid_ssn(v: Sql) -> Sql:
    return digits_of(v, 9, lambda d: ~F.rlike(d, F.lit("^(?:000|666|9)|^...00|0000$")), vary=False)


@on_columns
def is_valid_nif(v: Sql) -> Sql:
    return shaped(tidy(v), "[0-9]{8}[A-Z]", lambda x: letter(X.ES_LETTERS, number(x, 0, 8) % 23) == F.right(x, F.lit(1)))


@on_columns
def is_valid_nie(v: Sql) -> Sql:
    return shaped(tidy(v), "[XYZ][0-9]{7}[A-Z]", lambda x: letter(X.ES_LETTERS, F.translate(F.left(x, F.lit(8)), "XYZ", "012").cast("bigint") % 23) == F.right(x, F.lit(1)))


def mod_97(v: Sql) -> Sql:
    """The rest by 97 of the number that the characters stand for, letters as 10 to 35."""
    return F.aggregate(letter_values(v), F.lit(0), lambda a, x: F.when(x > 9, (a * 100 + x) % 97).otherwise((a * 10 + x) % 97))


@on_columns
def is_valid_iban(v: Sql) -> Sql:
    lengths = F.expr("map(" + ", ".join(f"'{c}', {n}" for c, n in X.IBAN_LENGTHS.items()) + ")")

    def check(x: Sql) -> Sql:
        own = F.try_element_at(lengths, F.left(x, F.lit(2)))
        fits = F.when(own.isNotNull(), F.length(x) == own).otherwise(F.length(x).between(15, 32))
        return F.when(fits, mod_97(F.concat(F.substring(x, 5, 100), F.left(x, F.lit(4)))) == 1).otherwise(no())

    return shaped(compact(v), "[A-Z]{2}[0-9]{2}[A-Z0-9]{11,28}", check)


@on_columns
def is_valid_nino(v: Sql) -> Sql:
    return shaped(compact(v), "[A-CEGHJ-PR-TW-Z]{2}[0-9]{6}[A-D]", lambda x: ~F.left(x, F.lit(2)).isin(*X.NINO_NEVER) & ~F.rlike(x, F.lit("^.[DFIOQUV]")))


@on_columns
def is_valid_nir(v: Sql) -> Sql:
    def check(x: Sql) -> Sql:
        keyed = F.replace(F.replace(F.left(x, F.lit(13)), F.lit("2A"), F.lit("19")), F.lit("2B"), F.lit("18"))
        return F.when(F.rlike(keyed, F.lit("^[0-9]{13}$")), 97 - keyed.cast("bigint") % 97 == F.right(x, F.lit(2)).cast("int")).otherwise(no())

    return shaped(compact(v), "[12][0-9]{2}(?:0[1-9]|1[0-2])(?:[0-9]{2}|2[AB])[0-9]{8}", check)


@on_columns
def is_valid_fiscal(v: Sql) -> Sql:
    odd = constants(list(X.FISCAL_ODD.values()))

    def check(x: Sql) -> Sql:
        day = number(x, 9, 2)
        face = letter_values(F.left(x, F.lit(15)))
        even = F.transform(face, lambda n: F.when(n > 9, n - 10).otherwise(n))
        each = F.transform(face, lambda n, i: F.when(i % 2 == 0, F.get(odd, n)).otherwise(F.get(even, i)))
        total = F.aggregate(each, F.lit(0), lambda a, n: a + n)
        return (day.between(1, 31) | day.between(41, 71)) & (F.ascii(F.right(x, F.lit(1))) == 65 + total % 26)

    return shaped(tidy(v), f"[A-Z]{{6}}[0-9]{{2}}[{X.FISCAL_MONTHS}][0-9]{{2}}[A-Z][0-9]{{3}}[A-Z]", check)


@on_columns
def is_valid_cpf(v: Sql) -> Sql:
    one, two = X.CPF_WEIGHTS
    return digits_of(v, 11, lambda d: (_low(weighted(d, one) % 11) == digit(d, 9)) & (_low(weighted(d, two) % 11) == digit(d, 10)))


@on_columns
def is_valid_de_idnr(v: Sql) -> Sql:
    return digits_of(v, 11, mod_11_10, "1-9")


@on_columns
def is_valid_bsn(v: Sql) -> Sql:
    return digits_of(v, 9, lambda d: weighted(d, X.BSN_WEIGHTS) % 11 == 0)


def _either_century(d: Sql) -> Sql:
    yy, mm, dd = number(d, 0, 2), number(d, 2, 2), number(d, 4, 2)
    return is_date(yy + 1900, mm, dd) | is_date(yy + 2000, mm, dd)


@on_columns
def is_valid_be_national(v: Sql) -> Sql:
    # 97 less the rest is 97 where the rest is 0
    key = lambda n: 97 - n % 97
    return digits_of(v, 11, lambda d: _either_century(d) & ((key(number(d, 0, 9)) == number(d, 9, 2)) | (key(number(d, 0, 9) + 2_000_000_000) == number(d, 9, 2))))


@on_columns
def is_valid_hetu(v: Sql) -> Sql:
    def check(x: Sql) -> Sql:
        sign = F.substring(x, 7, 1)
        century = F.when(sign == "+", 1800).when(sign == "-", 1900).otherwise(2000)
        whole = F.concat(F.left(x, F.lit(6)), F.substring(x, 8, 3)).cast("bigint")
        return is_date(century + number(x, 4, 2), number(x, 2, 2), number(x, 0, 2)) & (number(x, 7, 3) >= 2) & (letter(X.HETU_LETTERS, whole % 31) == F.right(x, F.lit(1)))

    return shaped(tidy(v), r"[0-9]{6}[+\-A][0-9]{3}[0-9A-Z]", check)


def _day_of_any_year(day: Sql, month: Sql) -> Sql:
    return is_date(F.lit(2000), month, day)


@on_columns
def is_valid_se_pnr(v: Sql) -> Sql:
    def check(d: Sql) -> Sql:
        ten = F.right(d, F.lit(10))
        day = number(ten, 4, 2)
        known = (F.length(d) == 10) | F.left(d, F.lit(2)).isin("18", "19", "20")
        return known & (F.size(F.array_distinct(chars(ten))) > 1) & _day_of_any_year(F.when(day > 60, day - 60).otherwise(day), number(ten, 2, 2)) & luhn(ten)

    return digits_of(v, (10, 12), lambda d: F.when(F.length(d) != 11, check(d)).otherwise(no()), vary=False)


@on_columns
def is_valid_no_fnr(v: Sql) -> Sql:
    # 11 less a rest of 0 counts as 0; 10 is never given and equals no digit
    key = lambda rest: (11 - rest) % 11
    one, two = X.NO_WEIGHTS
    return digits_of(v, 11, lambda d: _day_of_any_year(number(d, 0, 2), number(d, 2, 2)) & (key(weighted(d, one) % 11) == digit(d, 9)) & (key(weighted(d, two) % 11) == digit(d, 10)))


@on_columns
def is_valid_pt_nif(v: Sql) -> Sql:
    return digits_of(v, 9, lambda d: _low(weighted(d, X.PT_WEIGHTS) % 11) == digit(d, 8), "1-9")


@on_columns
def is_valid_ro_cnp(v: Sql) -> Sql:
    def check(d: Sql) -> Sql:
        kind = digit(d, 0)
        century = F.when(kind.isin(3, 4, 9), 1800).when(kind.isin(5, 6), 2000).otherwise(1900)
        rest = weighted(d, X.CNP_WEIGHTS) % 11
        return is_date(century + number(d, 1, 2), number(d, 3, 2), number(d, 5, 2)) & number(d, 7, 2).between(1, 52) & number(d, 9, 3).between(1, 999) & (F.when(rest == 10, 1).otherwise(rest) == digit(d, 12))

    return digits_of(v, 13, check, "1-9")


@on_columns
def is_valid_gr_afm(v: Sql) -> Sql:
    return digits_of(v, 9, lambda d: weighted(d, X.AFM_WEIGHTS) % 11 % 10 == digit(d, 8), "1-9")


@on_columns
def is_valid_aba(v: Sql) -> Sql:
    return digits_of(v, 9, lambda d: F.rlike(d, F.lit("^(?:0[0-9]|1[0-2]|2[1-9]|3[0-2]|6[1-9]|7[0-2]|80)")) & (weighted(d, X.ABA_WEIGHTS) % 10 == 0))


@on_columns
def is_valid_itin(v: Sql) -> Sql:
    return digits_of(v, 9, lambda d: number(d, 3, 2).between(70, 99) & ~number(d, 3, 2).isin(89, 93), "9")


@on_columns
def is_valid_isin(v: Sql) -> Sql:
    return shaped(compact(v), "[A-Z]{2}[A-Z0-9]{9}[0-9]", lambda x: luhn(F.array_join(letter_values(x).cast("array<string>"), "")))


@on_columns
def is_valid_sedol(v: Sql) -> Sql:
    return shaped(tidy(v), "(?=.*[0-9])[B-DF-HJ-NP-TV-Z0-9]{7}", lambda x: values_weighted(letter_values(x), X.SEDOL_WEIGHTS) % 10 == 0)


@on_columns
def is_valid_abn(v: Sql) -> Sql:
    return digits_of(v, 11, lambda d: (weighted(d, X.ABN_WEIGHTS) - X.ABN_WEIGHTS[0]) % 89 == 0, "1-9")


@on_columns
def is_valid_cn_id(v: Sql) -> Sql:
    def check(x: Sql) -> Sql:
        return (F.size(F.array_distinct(chars(x))) > 1) & is_date(number(x, 6, 4), number(x, 10, 2), number(x, 12, 2)) & (letter(X.CN_LETTERS, weighted(x, X.CN_WEIGHTS) % 11) == F.right(x, F.lit(1)))

    return shaped(tidy(v), "[0-9]{17}[0-9X]", check)


@on_columns
def is_valid_kr_rrn(v: Sql) -> Sql:
    def check(d: Sql) -> Sql:
        century = F.when(digit(d, 6).isin(1, 2, 5, 6), 1900).otherwise(2000)
        return digit(d, 6).between(1, 8) & is_date(century + number(d, 0, 2), number(d, 2, 2), number(d, 4, 2)) & ((11 - weighted(d, X.KR_WEIGHTS) % 11) % 10 == digit(d, 12))

    return digits_of(v, 13, check)


@on_columns
def is_valid_sg_nric(v: Sql) -> Sql:
    def check(x: Sql) -> Sql:
        rest = (weighted(x, X.SG_WEIGHTS, 1) + F.when(F.rlike(x, F.lit("^[TG]")), 4).otherwise(0)) % 11
        return F.when(F.rlike(x, F.lit("^[ST]")), letter(X.SG_LETTERS["ST"], rest)).otherwise(letter(X.SG_LETTERS["FG"], rest)) == F.right(x, F.lit(1))

    return shaped(tidy(v), "[STFG][0-9]{7}[A-Z]", check)


@on_columns
def is_valid_il_id(v: Sql) -> Sql:
    return digits_of(v, (1, 9), lambda d: luhn(F.lpad(d, 9, "0")))


@on_columns
def is_valid_za_id(v: Sql) -> Sql:
    return digits_of(v, 13, lambda d: _either_century(d) & (digit(d, 10) < 2) & luhn(d))


@on_columns
def is_valid_th_id(v: Sql) -> Sql:
    return digits_of(v, 13, lambda d: (11 - weighted(d, X.TH_WEIGHTS) % 11) % 10 == digit(d, 12), "1-8")


@on_columns
def is_valid_tw_id(v: Sql) -> Sql:
    def check(x: Sql) -> Sql:
        code = F.instr("".join(sorted(X.TW_LETTERS, key=X.TW_LETTERS.get)), F.left(x, 1)) + 9
        total = F.floor(code / 10).cast("int") + code % 10 * 9 + weighted(x, X.TW_WEIGHTS, 1)
        return (10 - total % 10) % 10 == digit(x, 9)

    return shaped(tidy(v), "[A-Z][0-9]{9}", check)


@on_columns
def is_valid_hk_id(v: Sql) -> Sql:
    def check(x: Sql) -> Sql:
        values = letter_values(F.left(x, F.length(x) - 1))
        # one letter has the second letter's weight
        first = F.when(F.length(x) == 9, 9).otherwise(8)
        total = F.aggregate(F.transform(values, lambda n, i: n * (first - i)), F.lit(0), lambda a, n: a + n)
        last = F.right(x, F.lit(1))
        return (total + F.when(last == "A", 10).otherwise(F.ascii(last) - 48)) % 11 == 0

    return shaped(F.regexp_replace(tidy(v), r"[\s()]", ""), "[A-Z]{1,2}[0-9]{6}[0-9A]", check)


@on_columns
def is_valid_jp_number(v: Sql) -> Sql:
    return digits_of(v, 12, lambda d: _low(weighted(d, X.JP_WEIGHTS) % 11) == digit(d, 11))


@on_columns
def is_valid_imei(v: Sql) -> Sql:
    return digits_of(v, 15, luhn)


@on_columns
def is_valid_vin(v: Sql) -> Sql:
    letters = "".join(X.VIN_LETTERS)
    codes = "".join(map(str, X.VIN_LETTERS.values()))

    def check(x: Sql) -> Sql:
        rest = values_weighted(numbers(F.translate(x, letters, codes)), X.VIN_WEIGHTS) % 11
        return F.when(rest == 10, "X").otherwise(rest.cast("string")) == F.substring(x, 9, 1)

    return shaped(tidy(v), "[A-HJ-NPR-Z0-9]{17}", check)


@on_columns
def is_valid_dea(v: Sql) -> Sql:
    return shaped(tidy(v), "[ABCDEFGHJKLMPRSTUX][A-Z][0-9]{7}", lambda x: weighted(x, (1, 2, 1, 2, 1, 2), 2) % 10 == digit(x, 8))


@on_columns
def is_valid_mbi(v: Sql) -> Sql:
    a = "[AC-HJKMNP-RT-Y]"
    an = "[AC-HJKMNP-RT-Y0-9]"
    return shaped(F.regexp_replace(tidy(v), r"[\s-]", ""), f"[0-9]{a}{an}[0-9]{a}{an}[0-9]{a}{an}[0-9][0-9]", lambda x: F.lit(True))


def _bech32(v: Sql) -> Sql:
    """The checksum of an address bc1...: a fold of its 5-bit values, the prefix's first."""
    place = lambda c: F.instr(F.lit(X.BECH32), c) - 1
    prefix = [ord(c) >> 5 for c in "bc"] + [0] + [ord(c) & 31 for c in "bc"]
    values = F.concat(constants(prefix), F.transform(chars(F.substring(v, 4, 100)), place))

    def step(state: Sql, x: Sql) -> Sql:
        top = F.shiftright(state, 25)
        out = F.shiftleft(state.bitwiseAND(F.lit(0x1FFFFFF)), 5).bitwiseXOR(x)
        for i, g in enumerate(X.BECH32_GENERATORS):
            out = F.when(F.shiftright(top, i).bitwiseAND(F.lit(1)) == 1, out.bitwiseXOR(F.lit(g))).otherwise(out)
        return out

    return F.aggregate(values, F.lit(1), step) == 1


@PF.udf(BooleanType())
def _base58(value):  # 200-bit integers are beyond Spark's decimals; few values come this far
    # Spark runs it on all rows, whatever condition stands around it
    if not value or not 26 <= len(value) <= 35 or value[0] not in "13" or set(value) - set(X.BASE58):
        return False
    n = 0
    for c in value:
        n = n * 58 + X.BASE58.index(c)
    raw = b"\0" * (len(value) - len(value.lstrip("1"))) + n.to_bytes((n.bit_length() + 7) // 8 or 1, "big")
    return len(raw) >= 5 and hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


def is_base58_address(v: Column) -> Column:
    """Run as a Python function, so not inside of a lambda."""
    bare = PF.regexp_replace(v, r"^\s+|\s+$", "")
    return PF.coalesce(PF.when(PF.rlike(bare, PF.lit("^[13][a-km-zA-HJ-NP-Z1-9]{25,34}$")), _base58(bare)), PF.lit(False))


def _double_sha(hexed: Sql) -> Sql:
    return F.sha2(F.unhex(F.sha2(F.unhex(hexed), 256)), 256)


@on_columns
def is_base58_native(v: Sql) -> Sql:
    """The same as is_base58_address() in columns only, for use inside of lambdas.

    The number is held in seven parts of 30 bits, which each character multiplies by 58.
    """
    parts = 7
    base = 1 << 30

    def step(state: Sql, c: Sql) -> Sql:
        carry0 = F.instr(F.lit(X.BASE58), c).cast("bigint") - 1

        def part(acc: Sql, x: Sql) -> Sql:
            total = x * 58 + acc["carry"]
            return F.struct(F.floor(total / base).cast("bigint").alias("carry"), F.concat(acc["out"], F.array((total % base).cast("bigint"))).alias("out"))

        start = F.struct(carry0.alias("carry"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(state, start, part, lambda a: a["out"])

    def check(x: Sql) -> Sql:
        number_ = F.aggregate(chars(x), F.array_repeat(F.lit(0).cast("bigint"), parts), step)
        bits = F.array_join(F.transform(F.reverse(number_), lambda n: F.lpad(F.bin(n), 30, "0")), "")
        return let(bits, lambda b: F.when(F.left(b, 10) == "0" * 10, let(_hexed(b), sound)).otherwise(no()))

    # 210 bits: the low 200 are the address, one version byte, a hash and four bytes of checksum
    def _hexed(bits: Sql) -> Sql:
        return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(24)), lambda i: F.lpad(F.conv(F.substring(bits, i * 8 + 11, F.lit(8)), 2, 16), 2, "0")), "")

    def sound(hexed: Sql) -> Sql:
        return F.left(F.lower(_double_sha(F.left(hexed, F.lit(42)))), F.lit(8)) == F.lower(F.right(hexed, F.lit(8)))

    # a leading 1 stands for a zero byte: as many as the number has beyond its length
    return shaped(F.regexp_replace(v, r"^\s+|\s+$", ""), "[13][a-km-zA-HJ-NP-Z1-9]{25,34}", check)


@on_columns
def is_valid_bech32(v: Sql) -> Sql:
    return shaped(F.lower(F.regexp_replace(v, r"^\s+|\s+$", "")), f"bc1[{X.BECH32}]+", _bech32)


def is_valid_btc(v: Column) -> Column:
    return is_base58_address(v) | is_valid_bech32(v)


@on_columns
def is_valid_eth(v: Sql) -> Sql:
    return F.coalesce(F.rlike(v, F.lit(r"^\s*0x[0-9a-fA-F]{40}\s*$")), no())


@on_columns
def is_valid_eth_eip55(v: Sql) -> Sql:
    """Forms of one case; mixed case needs a hash that Spark lacks, and is not confirmed."""
    return F.coalesce(F.rlike(v, F.lit(r"^\s*0x(?:[0-9a-f]{40}|[0-9A-F]{40})\s*$")), no())


@on_columns
def eth_confidence(v: Sql) -> Sql:
    return F.when(is_valid_eth(v), 0.85).otherwise(0.0)


@on_columns
def is_valid_vkn(v: Sql) -> Sql:
    powers = constants([2 ** (9 - i) % 11 for i in range(9)])

    def check(d: Sql) -> Sql:
        each = F.transform(numbers(F.left(d, F.lit(9))), lambda x, i: ((x + 9 - i) % 10 * F.get(powers, i)) % 11)
        return (10 - F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10) % 10 == digit(d, 9)

    return digits_of(v, 10, check, "1-9")


@on_columns
def is_valid_de_tax_id(v: Sql) -> Sql:
    return F.coalesce(F.rlike(v, F.lit(r"[/.\- ]")), no()) & digits_of(v, (10, 13), mod_11_10, "1-9", vary=False)


@on_columns
def is_valid_pan(v: Sql) -> Sql:
    return shaped(tidy(v), f"[A-Z]{{3}}[{X.PAN_HOLDERS}][A-Z][0-9]{{4}}[A-Z]", lambda x: F.lit(True))


@on_columns
def is_valid_tfn(v: Sql) -> Sql:
    return digits_of(v, 9, lambda d: weighted(d, X.TFN_WEIGHTS) % 11 == 0)


@on_columns
def is_valid_sin(v: Sql) -> Sql:
    return digits_of(v, 9, luhn, "1-7")


@on_columns
def is_valid_aadhaar(v: Sql) -> Sql:
    table = lambda rows: F.expr("array(" + ", ".join("array(" + ", ".join(map(str, row)) + ")" for row in rows) + ")")
    d_table, p_table = table(X.VERHOEFF_D), table(X.VERHOEFF_P)

    def check(d: Sql) -> Sql:
        permuted = F.transform(numbers(F.reverse(d)), lambda x, i: F.get(F.get(p_table, i % 8), x))
        return F.aggregate(permuted, F.lit(0), lambda c, x: F.get(F.get(d_table, c), x)) == 0

    return digits_of(v, 12, check, "2-9")


@on_columns
def is_valid_npi(v: Sql) -> Sql:
    return digits_of(v, 10, lambda d: luhn(F.concat(F.lit("80840"), d)), "12")


@on_columns
def is_valid_coordinates(v: Sql) -> Sql:
    whole = r"\s*[+-]?(?:[1-8]?[0-9]\.[0-9]+|90\.0+)\s*[,;]\s*[+-]?(?:(?:1[0-7][0-9]|[1-9]?[0-9])\.[0-9]+|180\.0+)\s*"
    part = lambda x, i: F.abs(F.regexp_extract(x, r"([+-]?[0-9.]+)\s*[,;]\s*([+-]?[0-9.]+)", i).cast("double"))
    return shaped(v, whole, lambda x: (part(x, 1) <= 90) & (part(x, 2) <= 180))


def country_codes() -> list[str]:
    """ISO 3166-1 alpha-2, from the Java runtime, and XK, which payment networks use."""
    spark = SparkSession.getActiveSession()
    return sorted({*spark._jvm.java.util.Locale.getISOCountries(), "XK"})


@on_columns
def is_valid_bic(v: Sql) -> Sql:
    return shaped(tidy(v), "[A-Z]{6}[A-Z0-9]{2}(?:[A-Z0-9]{3})?", lambda x: F.instr(F.lit(" ".join(country_codes())), F.substring(x, 5, 2)) > 0)


def _mrz_digit(v: Sql) -> Sql:
    value = lambda c: F.when(F.rlike(c, F.lit("[0-9]")), F.ascii(c) - 48).when(c == "<", 0).otherwise(F.ascii(c) - 55)
    weights = constants(X.MRZ_WEIGHTS)
    each = F.transform(chars(v), lambda c, i: value(c) * F.get(weights, i % 3))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10


@on_columns
def is_valid_mrz_line2(v: Sql) -> Sql:
    def check(x: Sql) -> Sql:
        part = lambda a, b: F.substring(x, a + 1, b - a)
        ok = part(43, 44) == _mrz_digit(F.concat(part(0, 10), part(13, 20), part(21, 43))).cast("string")
        for a, b in ((0, 9), (13, 19), (21, 27), (28, 42)):
            ok = ok & (part(b, b + 1) == _mrz_digit(part(a, b)).cast("string"))
        return ok

    return shaped(v, "[A-Z0-9<]{44}", check)


@on_columns
def is_plausible_jwt(v: Sql) -> Sql:
    """The first part is base64url of a JSON object with alg or typ."""
    head = F.translate(F.get(F.split(v, r"\."), 0), "-_", "+/")
    padded = F.concat(head, F.repeat(F.lit("="), F.pmod(-F.length(head), F.lit(4))))
    text = F.try_to_binary(padded, F.lit("base64")).cast("string")
    keys = F.json_object_keys(text)
    return F.coalesce(F.array_contains(keys, "alg") | F.array_contains(keys, "typ"), no())


#: The check of each type that has one.
CHECKS = {
    "TR_NATIONAL_ID": is_valid_tr_national_id, "CREDIT_CARD": is_valid_luhn, "PL_PESEL": is_valid_pesel, "US_SSN": is_valid_ssn, "ES_NIF": is_valid_nif, "ES_NIE": is_valid_nie, "GB_NINO": is_valid_nino, "FR_NIR": is_valid_nir,
    "IT_FISCAL": is_valid_fiscal, "BR_CPF": is_valid_cpf, "DE_IDNR": is_valid_de_idnr, "NL_BSN": is_valid_bsn, "BE_NATIONAL_ID": is_valid_be_national, "FI_HETU": is_valid_hetu, "SE_PERSONNUMMER": is_valid_se_pnr,
    "NO_FODSELSNUMMER": is_valid_no_fnr, "PT_NIF": is_valid_pt_nif, "RO_CNP": is_valid_ro_cnp, "GR_AFM": is_valid_gr_afm, "US_ABA": is_valid_aba, "US_ITIN": is_valid_itin, "ISIN": is_valid_isin, "SEDOL": is_valid_sedol,
    "AU_ABN": is_valid_abn, "CN_ID": is_valid_cn_id, "KR_RRN": is_valid_kr_rrn, "SG_NRIC": is_valid_sg_nric, "IL_ID": is_valid_il_id, "ZA_ID": is_valid_za_id, "TH_ID": is_valid_th_id, "TW_ID": is_valid_tw_id, "HK_ID": is_valid_hk_id,
    "JP_MY_NUMBER": is_valid_jp_number, "IMEI": is_valid_imei, "VIN": is_valid_vin, "US_DEA": is_valid_dea, "US_MBI": is_valid_mbi, "BTC_ADDRESS": is_valid_btc, "ETH_ADDRESS": is_valid_eth, "TR_VKN": is_valid_vkn,
    "DE_TAX_ID": is_valid_de_tax_id, "IN_PAN": is_valid_pan, "AU_TFN": is_valid_tfn, "CA_SIN": is_valid_sin, "IN_AADHAAR": is_valid_aadhaar, "US_NPI": is_valid_npi, "COORDINATES": is_valid_coordinates, "SWIFT_BIC": is_valid_bic,
    "IBAN": is_valid_iban, "JWT": is_plausible_jwt,
}
