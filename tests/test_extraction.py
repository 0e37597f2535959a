"""Names on cards, and validators."""

import pytest
from pyspark.sql import functions as F

from papersluice.functions import text
from papersluice.operators import extract

NONE = None
CASES = [
    ("Government of India\nAnjali\nDOB: 01/01/2000", [], "Anjali"),
    ("GOVERNMENT OF INDIA\nANJALI\nDOB: 01/01/2000", [], "ANJALI"),
    ("Government of India\nMukesh Kumar\nDOB: 01/01/1980", [], "Mukesh Kumar"),
    ("UIDAI\nName: Anjali Kumari\nDOB: 01/01/2000", [], "Anjali Kumari"),
    ("Government of India\nAnjali\nDOB: 01/01/2000\nFemale\nAddress:\nS/O: Mukesh Kumar", [], "Anjali"),
    ("Government of India\nUnique Identification Authority\nAnjali", [], "Anjali"),
    ("Government of India\nAnjali\nKumari\nDOB: 01/01/2000", ["Government of India", "Anjali", "Kumari", "DOB: 01/01/2000"], "Anjali Kumari"),
]


def test_names(spark):
    frame = spark.createDataFrame([(i, t, ls) for i, (t, ls, _) in enumerate(CASES)], "doc_id int, full_text string, ls array<string>")
    got = {r.doc_id: r["name"] for r in extract.wide(frame, "aadhaar", lines="ls").collect()}
    assert [got[i] for i in range(len(CASES))] == [want for _, _, want in CASES]


@pytest.mark.parametrize(
    ("function", "value", "want"),
    [
        (text.fix_pan, "A8CPD12O4E", "ABCPD1204E"),
        (text.fix_pan, "ABCPD12?4E", None),
        (text.format_registration, "dl 01 ab 1234", "DL-01-AB-1234"),
        (text.valid_registration, "DL00AB1234", False),
        (text.valid_registration, "DL01AB1234", True),
        (text.normalize_date, "1-2-2020", "01/02/2020"),
        (text.normalize_date, "2020.3.4", "04/03/2020"),
        (text.normalize_date, "x", None),
        (text.standardize_date, "02/03/2020", "2020-02-03"),
        (text.standardize_date, "25/03/2020", "2020-03-25"),
        (text.plausible_date, "31/02/2020", True),
        (text.plausible_date, "01.02.2020", False),
        (text.valid_aadhaar, "१23456789012", False),
        (text.valid_aadhaar, "२३४५६७८९०१२३", True),
        (text.valid_pan, "ABCPD1234E", True),
        (text.valid_pan, "ABCXD1234E", False),
        (text.valid_name_pan, "RAVI KUMAR", True),
        (text.valid_name_pan, "RAVI", False),
        (text.valid_name_aadhaar, "A.K. Sharma", True),
        (text.valid_name_aadhaar, "A", False),
        (text.valid_name_rc, "MODEL TOWN", False),
        (text.squeeze_layout, "  a   b\n\n\nc ", "a b\nc"),
        (text.is_numeric, "$12,3a", True),
    ],
)
def test_functions(spark, function, value, want):
    assert spark.createDataFrame([(value,)], "t string").select(function(F.col("t")).alias("v")).first().v == want


# What the rules of each type say of these texts, worked out by hand.
GOLDENS = [
    ("vehicle_rc", "OWNER NAME RAVI KUMAR.", {"owner_name": "NAME RAVI KUMAR", "registration_number": None}),
    ("vehicle_rc", "Regn No. KA 05 MH 2021\nHYPOTHECATION TO HDFC BANK LTD.\nInsurance upto 01-02-2030", {"registration_number": "KA-05-MH-2021", "hypothecation": "HDFC BANK LTD", "insurance_validity_date": "01/02/2030"}),
    ("vehicle_rc", "Fitness valid: 05.06.2031\nWheel Base: 2450\nUnladen Wt: 950\nColour: RED", {"fitness_validity_date": "05/06/2031", "wheelbase": "2450", "unladen_weight": "950", "vehicle_color": "RED"}),
    ("vehicle_rc", "VIN MA3EWDE1S00123456\nENG NO K12MN1234567\nPropulsion: Electric\nVehicle Class: MCWG\nCap: 4\nMfg 2015", {"chassis_number": "MA3EWDE1S00123456", "engine_number": "K12MN1234567", "fuel_type": "ELECTRIC", "vehicle_class": "MCWG", "seating_capacity": "4", "manufacturing_date": "2015"}),
    ("vehicle_rc", "Maker: HERO MOTOCORP\nModel: Splendor+\nKA01AB1234 MH12DE1433", {"vehicle_make_model": "HERO MOTOCORP MODEL", "registration_number": None}),
    ("pan", "INCOME TAX\nABCPDI2O4E", {"pan_number": "ABCPD1204E", "signature_present": None}),
    ("pan", "abcpd1234e", {"pan_number": "ABCPD1234E"}),
    ("pan", "card ABCPD 1234E", {"pan_number": "ABCPD1234E"}),
    ("pan", "ABCPD1234E and XYZCA9876B", {"pan_number": None}),
    ("pan", "Father's Name: SURESH KUMAR\n01/02/1990\nhastakshar", {"father_name": "SURESH KUMAR", "date_of_birth": "01/02/1990", "signature_present": "true"}),
    ("aadhaar", "मेरा आधार 2345-6789-0123\nमहिला\n1234/56789/01234", {"aadhaar_number": "234567890123", "gender": "Female", "enrollment_id": "1234/56789/01234"}),
    ("aadhaar", "Virtual ID 9876 5432 1098 7654\nDOB: ०१/०२/१९९०\nTransgender", {"vid": "9876543210987654", "date_of_birth": "01/02/1990", "gender": "Other"}),
    ("aadhaar", "DOB: 01021990\nMALE\n234567890123", {"date_of_birth": "01/02/1990", "gender": "Male", "aadhaar_number": "234567890123"}),
    ("aadhaar", "DOB: 31/12/2025\n123456789012\nPIN 012345 or 560001", {"date_of_birth": None, "aadhaar_number": None, "pin_code": "560001"}),
    ("aadhaar", "Government of India\nAsha Rao\nDOB: 01/01/1990\n12 Long Garden Road\nNear Old Temple Gate\nPune Maharashtra\n411001 x", {"name": "Asha Rao", "address": "12 Long Garden Road Near Old Temple Gate Pune Maharashtra", "pin_code": "411001"}),
]


@pytest.mark.parametrize("kind", ["vehicle_rc", "pan", "aadhaar"])
def test_goldens(spark, kind):
    own = [(i, t, want) for i, (k, t, want) in enumerate(GOLDENS) if k == kind]
    frame = spark.createDataFrame([(i, t) for i, t, _ in own], "doc_id int, full_text string")
    got = {r.doc_id: r.asDict() for r in extract.wide(frame, kind).collect()}
    assert {i: {f: got[i][f] for f in want} for i, _, want in own} == {i: want for i, _, want in own}
