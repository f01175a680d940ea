"""Table layouts and the value rules of the feature record."""

from __future__ import annotations

from pyspark.sql import types as T

# Names, allowed texts and ranges of the feature record.
YES_NO = ["Yes", "No"]
INTERNET_ADDON = ["Yes", "No", "No internet service"]
ALLOWED = {
    "gender": ["Male", "Female"],
    "Partner": YES_NO,
    "Dependents": YES_NO,
    "PhoneService": YES_NO,
    "MultipleLines": ["Yes", "No", "No phone service"],
    "InternetService": ["DSL", "Fiber optic", "No"],
    "OnlineSecurity": INTERNET_ADDON,
    "OnlineBackup": INTERNET_ADDON,
    "DeviceProtection": INTERNET_ADDON,
    "TechSupport": INTERNET_ADDON,
    "StreamingTV": INTERNET_ADDON,
    "StreamingMovies": INTERNET_ADDON,
    "Contract": ["Month-to-month", "One year", "Two year"],
    "PaperlessBilling": YES_NO,
    "PaymentMethod": [
        "Electronic check",
        "Mailed check",
        "Bank transfer (automatic)",
        "Credit card (automatic)",
    ],
}
RANGES = {
    "SeniorCitizen": (0, 1),
    "tenure": (0, 100),
    "MonthlyCharges": (0.0, 200.0),
    "TotalCharges": (0.0, None),
}
NUMERICAL_FEATURES = ["tenure", "MonthlyCharges", "TotalCharges"]
CATEGORICAL_FEATURES = list(ALLOWED)
TARGET = "Churn"
ID_COLUMN = "customerID"
REQUEST_ID_LENGTH = (1, 36)

FEATURE_RECORD = T.StructType(
    [T.StructField(name, T.StringType()) for name in ALLOWED]
    + [
        T.StructField("SeniorCitizen", T.IntegerType()),
        T.StructField("tenure", T.IntegerType()),
        T.StructField("MonthlyCharges", T.DoubleType()),
        T.StructField("TotalCharges", T.DoubleType()),
    ]
)

# The raw file as delivered: charges stay text because they contain blanks.
RAW_TABLE = T.StructType(
    [T.StructField(ID_COLUMN, T.StringType())]
    + [
        T.StructField(f.name, T.StringType() if f.name == "TotalCharges" else f.dataType)
        for f in FEATURE_RECORD.fields
    ]
    + [T.StructField(TARGET, T.StringType())]
)

PREDICTION_LOG = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("request_id", T.StringType(), False),
        T.StructField("features", T.StringType(), False),
        T.StructField("prediction", T.IntegerType(), False),
        T.StructField("probability", T.DoubleType(), False),
        T.StructField("model_version", T.StringType(), False),
        T.StructField("drift_analyzed", T.BooleanType(), False),
        T.StructField("created_at", T.TimestampType(), False),
        T.StructField("actual_label", T.IntegerType(), True),
        T.StructField("label_received_at", T.TimestampType(), True),
    ]
)

LABEL_BATCH = T.StructType(
    [T.StructField("request_id", T.StringType()), T.StructField("actual_label", T.IntegerType())]
)
