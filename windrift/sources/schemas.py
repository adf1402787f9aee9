"""Declared schemas of the KPI table and the overlap relation.

Declaring the schema avoids the extra inference scan over the input and
gives stable types whatever the first rows hold.
"""

from __future__ import annotations

from pyspark.sql import types as T

# The measurement column names and types of the KPI table,
# in file order.  They must equal the producer's header for a CSV read by
# position, so they are kept exactly as the source names them.
KPI_FIELDS: list[tuple[str, T.DataType]] = [
    ("DATETIME", T.TimestampType()),
    ("CELL", T.StringType()),
    ("CARRIER", T.IntegerType()),
    ("FREQ", T.DoubleType()),
    ("AZIMUTH", T.IntegerType()),
    ("LAT", T.DoubleType()),
    ("LON", T.DoubleType()),
    ("Traffic_Volume_Gbyte", T.DoubleType()),
    ("Nof_Avg_SimRRC_ConnUsr", T.DoubleType()),
    ("NOF_AVG_VOLTE_USER_HWI", T.DoubleType()),
    ("NUM_OF_RRC_Att", T.IntegerType()),
    ("ERAB_ESTAB_ATT", T.IntegerType()),
    ("AVGUL_RSSI_WEIGH_DBM_PUCCH", T.DoubleType()),
    ("AVGUL_RSSI_WEIGH_DBM_PUSCH", T.DoubleType()),
    ("AVG_RACH_TA", T.DoubleType()),
    ("VOLTE_TRAFFIC_ERL", T.DoubleType()),
    ("DLPRBUtilization", T.DoubleType()),
    ("DL_PRB_Util_%_HWI", T.DoubleType()),
    ("Avg_UL_RSRP_PUSCH", T.DoubleType()),
    ("Avg_UL_RSRP_PUCCH", T.DoubleType()),
    ("L.UL.Interference.Max", T.DoubleType()),
    ("L.UL.Interference.Avg", T.DoubleType()),
    ("L.UL.Interference.Min", T.DoubleType()),
    ("ERAB_ATTEMPT", T.IntegerType()),
    ("Average_UL_RSRP_PUSCH", T.DoubleType()),
    ("AvailTime_Auto_PC_HWI", T.DoubleType()),
    ("RRC_EstabSucc_PC", T.DoubleType()),
    ("ERAB_Drop_PC", T.DoubleType()),
    ("DL_PDCP_USER_THPUT", T.DoubleType()),
    ("UL_PDCP_USER_THPUT_HWI", T.DoubleType()),
    ("INTERFREQ_HO_SR", T.DoubleType()),
    ("INTRAFREQ_HO_SR", T.DoubleType()),
    ("ACTIVEUSER_DL_QCI1", T.DoubleType()),
    ("ACTIVEUSER_UL_QCI1", T.DoubleType()),
    ("Avg_CQI_HWI", T.DoubleType()),
    ("AVG_MCS_PUSCH", T.DoubleType()),
    ("AVG_SimRRC_ConnUsr_COUNT", T.DoubleType()),
    ("E-RAB_SETUP_SUCCESS_RATE", T.DoubleType()),
    ("HO_Succ_PC_In", T.DoubleType()),
    ("MAC_UL_IBLER", T.DoubleType()),
    ("MAC_DL_IBLER", T.DoubleType()),
    ("MAC_UL_RBLER", T.DoubleType()),
    ("MAC_DL_RBLER", T.DoubleType()),
    ("UL_PACKET_LOSS", T.DoubleType()),
    ("UL_PRB_Util_%", T.DoubleType()),
]

# Per-PRB interference columns follow the named ones: a rule, not a list.
PRB_COLUMN_PATTERN = "L.UL.Interference.Avg.PRB{}"
PRB_COUNT = 100

# Overlap relation column names.
OVERLAP_FIELDS: list[tuple[str, T.DataType]] = [
    ("CELL", T.StringType()),
    ("N_CELL", T.StringType()),
    ("Overlap_Alan%", T.DoubleType()),
]
OVERLAP_PCT = "Overlap_Alan%"

# Index columns a CSV writer may leave in front of the data.
INDEX_COLUMNS = ("_c0", "Unnamed: 0")

KPI_TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"


def kpi_schema(with_corrupt: bool = False) -> T.StructType:
    fields = [T.StructField(n, t, True) for n, t in KPI_FIELDS]
    fields += [T.StructField(PRB_COLUMN_PATTERN.format(i), T.DoubleType(), True) for i in range(PRB_COUNT)]
    if with_corrupt:
        fields.append(T.StructField("_corrupt_record", T.StringType(), True))
    return T.StructType(fields)


def overlap_schema(with_index: bool = False) -> T.StructType:
    fields = [T.StructField(n, t, True) for n, t in OVERLAP_FIELDS]
    if with_index:
        fields = [T.StructField("_c0", T.IntegerType(), True)] + fields
    return T.StructType(fields)
