"""Column names and types of the tables the stages read and write."""

from __future__ import annotations

from pyspark.sql import types as T

ADMISSIONS = T.StructType([
    T.StructField("PatientID", T.LongType()),
    T.StructField("EthnicGroupDSC", T.StringType()),
    T.StructField("SexDSC", T.StringType()),
    T.StructField("Age", T.IntegerType()),
    T.StructField("PatientRaceDSC", T.StringType()),
    T.StructField("HospitalAdmitDTS", T.StringType()),
    T.StructField("HospitalDischargeDTS", T.StringType()),
    T.StructField("mrs", T.DoubleType()),
    T.StructField("DischargeDispositionDSC", T.StringType()),
    T.StructField("stroketype", T.StringType()),
    T.StructField("Date_mrs_post_discharge", T.StringType()),
    T.StructField("mrs_90days", T.DoubleType()),
])

NOTE_LINES = T.StructType([
    T.StructField("PatientID", T.LongType()),
    T.StructField("NoteID", T.LongType()),
    T.StructField("LineNBR", T.IntegerType()),
    T.StructField("ContactDTS", T.StringType()),
    T.StructField("InpatientNoteTypeDSC", T.StringType()),
    T.StructField("NoteTXT", T.StringType()),
])

SCORED_ADMISSIONS = T.StructType([
    T.StructField("Admission", T.LongType()),
    T.StructField("SexDSC", T.IntegerType()),
    T.StructField("Age", T.IntegerType()),
    T.StructField("mrs", T.IntegerType()),
    T.StructField("Expired", T.IntegerType()),
    T.StructField("follow_up", T.IntegerType()),
])

VALIDATION_ADMISSIONS = T.StructType([
    T.StructField("Admission", T.LongType()),
    T.StructField("gender", T.IntegerType()),
    T.StructField("Age", T.IntegerType()),
    T.StructField("mrs", T.StringType()),
    T.StructField("race", T.StringType()),
    T.StructField("ethnic_group", T.IntegerType()),
    T.StructField("Discharge disposition", T.StringType()),
    T.StructField("follow_up", T.IntegerType()),
    T.StructField("Expired", T.IntegerType()),
])

EXTRACTIONS = T.StructType([
    T.StructField("Admission", T.LongType()),
    T.StructField("mrs_extractions", T.DoubleType()),
])

DATE_COLUMNS = ("HospitalAdmitDTS", "HospitalDischargeDTS", "Date_mrs_post_discharge", "ContactDTS")

# One admission with one outcome
ADMISSION_KEYS = ["PatientID", "SexDSC", "Age", "HospitalAdmitDTS", "HospitalDischargeDTS",
                  "Date_mrs_post_discharge", "mrs", "DischargeDispositionDSC"]

# The admission key of the extraction stage
VISIT_KEYS = ["PatientID", "HospitalAdmitDTS", "HospitalDischargeDTS", "Date_mrs_post_discharge"]

# One modelling document
DOCUMENT_KEYS = ["PatientID", "SexDSC", "Age", "HospitalAdmitDTS", "HospitalDischargeDTS",
                 "mrs", "Expired", "follow_up"]
