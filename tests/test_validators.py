"""Single values that are valid or not, for each check."""

import pytest
from pyspark.sql import functions as F

from veilwright.functions import validators as V

VECTORS = [
    ("is_valid_tr_national_id", "10000000146", True),
    ("is_valid_tr_national_id", "12345678901", False),
    ("is_valid_luhn", "4539148803436467", True),
    ("is_valid_luhn", "4539148803436468", False),
    ("is_valid_pesel", "44051401359", True),
    ("is_valid_pesel", "44051401358", False),
    ("is_valid_ssn", "078-05-1120", True),
    ("is_valid_ssn", "666-12-3456", False),
    ("is_valid_ssn", "900-12-3456", False),
    ("is_valid_nif", "12345678Z", True),
    ("is_valid_nif", "12345678A", False),
    ("is_valid_nie", "X1234567L", True),
    ("is_valid_nie", "X1234567A", False),
    ("is_valid_iban", "DE89370400440532013000", True),
    ("is_valid_iban", "TR330006100519786457841326", True),
    ("is_valid_iban", "DE89370400440532013001", False),
    ("is_valid_nino", "AB123456C", True),
    ("is_valid_nino", "DA123456C", False),
    ("is_valid_nir", "184127500512135", True),
    ("is_valid_nir", "184127500512136", False),
    ("is_valid_fiscal", "RSSMRA80A01H501U", True),
    ("is_valid_fiscal", "RSSMRA80A01H501A", False),
    ("is_valid_cpf", "111.444.777-35", True),
    ("is_valid_cpf", "111.444.777-36", False),
    ("is_valid_de_idnr", "86095742719", True),
    ("is_valid_de_idnr", "86095742718", False),
    ("is_valid_bsn", "123456782", True),
    ("is_valid_bsn", "123456783", False),
    ("is_valid_be_national", "93051822361", True),
    ("is_valid_be_national", "93051822365", False),
    ("is_valid_hetu", "131052-308T", True),
    ("is_valid_hetu", "131052-308U", False),
    ("is_valid_se_pnr", "1212121212", True),
    ("is_valid_se_pnr", "121212-1212", True),
    ("is_valid_se_pnr", "1212121213", False),
    ("is_valid_no_fnr", "01010112377", True),
    ("is_valid_no_fnr", "01010112378", False),
    ("is_valid_pt_nif", "123456789", True),
    ("is_valid_pt_nif", "123456788", False),
    ("is_valid_ro_cnp", "1900101400012", True),
    ("is_valid_ro_cnp", "1900101400013", False),
    ("is_valid_gr_afm", "123456783", True),
    ("is_valid_gr_afm", "123456784", False),
    ("is_valid_aba", "021000021", True),
    ("is_valid_aba", "021000022", False),
    ("is_valid_itin", "900-70-1234", True),
    ("is_valid_itin", "900-69-1234", False),
    ("is_valid_itin", "078-05-1120", False),
    ("is_valid_isin", "US0378331005", True),
    ("is_valid_isin", "US0378331006", False),
    ("is_valid_sedol", "0263494", True),
    ("is_valid_sedol", "0263495", False),
    ("is_valid_abn", "51824753556", True),
    ("is_valid_abn", "51824753557", False),
    ("is_valid_cn_id", "11010519491231002X", True),
    ("is_valid_cn_id", "110105194912310021", False),
    ("is_valid_kr_rrn", "9001011234568", True),
    ("is_valid_kr_rrn", "9001011234567", False),
    ("is_valid_sg_nric", "S1234567D", True),
    ("is_valid_sg_nric", "T1234567J", True),
    ("is_valid_sg_nric", "F1234567N", True),
    ("is_valid_sg_nric", "G1234567X", True),
    ("is_valid_sg_nric", "S1234567A", False),
    ("is_valid_il_id", "02498327", True),
    ("is_valid_il_id", "02498328", False),
    ("is_valid_za_id", "8001015009087", True),
    ("is_valid_za_id", "8001015009088", False),
    ("is_valid_th_id", "1234567890121", True),
    ("is_valid_th_id", "1234567890122", False),
    ("is_valid_tw_id", "A123456789", True),
    ("is_valid_tw_id", "A123456788", False),
    ("is_valid_hk_id", "A123456(8)", True),
    ("is_valid_hk_id", "A123456(7)", False),
    ("is_valid_jp_number", "123456789018", True),
    ("is_valid_jp_number", "123456789019", False),
    ("is_valid_imei", "490154203237518", True),
    ("is_valid_imei", "490154203237519", False),
    ("is_valid_vin", "1HGCM82633A004352", True),
    ("is_valid_vin", "1HGCM82634A004352", False),
    ("is_valid_dea", "AB1234563", True),
    ("is_valid_dea", "AB1234564", False),
    ("is_valid_mbi", "1EG4-TE5-MK73", True),
    ("is_valid_mbi", "1EG4TE5MK73", True),
    ("is_valid_mbi", "1SG4-TE5-MK73", False),
    ("is_valid_btc", "1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa", True),
    ("is_valid_btc", "1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNb", False),
    ("is_valid_btc", "bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t4", True),
    ("is_valid_eth", "0x742d35Cc6634C0532925a3b844Bc454e4438f44e", True),
    ("is_valid_eth", "0x742d35Cc6634C0532925a3b844Bc454e4438f44", False),
    ("is_valid_vkn", "1234567890", True),
    ("is_valid_vkn", "1234567891", False),
    ("is_valid_de_tax_id", "12/345/67805", True),
    ("is_valid_de_tax_id", "12/345/67806", False),
    ("is_valid_pan", "ABCPE1234F", True),
    ("is_valid_pan", "ABCPE1234X", True),
    ("is_valid_pan", "ABCXE1234F", False),
    ("is_valid_pan", "ABCDE123F", False),
    ("is_valid_tfn", "123 456 782", True),
    ("is_valid_tfn", "123456783", False),
    ("is_valid_sin", "193 456 787", True),
    ("is_valid_sin", "193-456-788", False),
    ("is_valid_aadhaar", "2345 6789 0124", True),
    ("is_valid_aadhaar", "234567890125", False),
    ("is_valid_npi", "1043477615", True),
    ("is_valid_npi", "1043477616", False),
    ("is_valid_coordinates", "40.7128, -74.0060", True),
    ("is_valid_coordinates", "91.0, 0.0", False),
    ("is_valid_bic", "DEUTDEFF500", True),
    ("is_valid_bic", "DEUTXXFF", False),
]


def test_vectors(spark):
    frame = spark.createDataFrame([(i, v) for i, (_, v, _) in enumerate(VECTORS)], "i int, v string").repartition(1)
    for name in sorted({f for f, _, _ in VECTORS}):
        places = [i for i, (f, _, _) in enumerate(VECTORS) if f == name]
        got = {r.i: r.ok for r in frame.filter(F.col("i").isin(places)).select("i", getattr(V, name)(F.col("v")).alias("ok")).collect()}
        assert got == {i: VECTORS[i][2] for i in places}, name


@pytest.mark.parametrize("name", sorted(V.CHECKS))
def test_null_and_empty(spark, name):
    frame = spark.createDataFrame([(None,), ("",), ("x",)], "v string")
    assert [r.ok for r in frame.select(V.CHECKS[name](F.col("v")).alias("ok")).collect()] == [False] * 3


def test_pesel_dates(spark):
    values = ["44051401359", "02210100000", "44330100000"]
    frame = spark.createDataFrame([(v,) for v in values], "v string")
    assert [str(r.d) for r in frame.select(V.extract_pesel_dob(F.col("v")).alias("d")).collect()] == ["1944-05-14", "2002-01-01", "None"]
