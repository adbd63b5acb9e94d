"""Declared schemas and the fixed values the results depend on.

Nothing is inferred at read time: both fact tables have an explicit StructType.
"""

from __future__ import annotations

from pyspark.sql import types as T

# customers fact table: 21 columns in load (positional) order.
CUSTOMERS_SCHEMA = T.StructType([
    T.StructField("customer_id", T.StringType(), False),
    T.StructField("gender", T.StringType()),
    T.StructField("senior_citizen", T.IntegerType()),
    T.StructField("partner", T.StringType()),
    T.StructField("dependents", T.StringType()),
    T.StructField("subscription_months", T.IntegerType()),
    T.StructField("phone_service", T.StringType()),
    T.StructField("multiple_lines", T.StringType()),
    T.StructField("internet_service", T.StringType()),
    T.StructField("online_security", T.StringType()),
    T.StructField("online_backup", T.StringType()),
    T.StructField("device_protection", T.StringType()),
    T.StructField("tech_support", T.StringType()),
    T.StructField("streaming_tv", T.StringType()),
    T.StructField("streaming_movies", T.StringType()),
    T.StructField("plan_type", T.StringType()),
    T.StructField("paperless_billing", T.StringType()),
    T.StructField("payment_method", T.StringType()),
    T.StructField("monthly_mrr", T.DecimalType(8, 2)),
    T.StructField("lifetime_value", T.DecimalType(10, 2)),
    T.StructField("churned", T.StringType()),
])

# ab_test fact table.
AB_TEST_SCHEMA = T.StructType([
    T.StructField("user_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("grp", T.StringType()),
    T.StructField("landing_page", T.StringType()),
    T.StructField("converted", T.IntegerType()),
])

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's for the same results)
# ---------------------------------------------------------------------------

# Source CSV header of the customer file, in file order.
CUSTOMER_CSV_HEADER = [
    "customerID", "gender", "SeniorCitizen", "Partner", "Dependents", "tenure",
    "PhoneService", "MultipleLines", "InternetService", "OnlineSecurity", "OnlineBackup",
    "DeviceProtection", "TechSupport", "StreamingTV", "StreamingMovies", "Contract",
    "PaperlessBilling", "PaymentMethod", "MonthlyCharges", "TotalCharges", "Churn",
]

# Explicit renames applied before the CamelCase -> snake_case rule.
CUSTOMER_RENAMES = {
    "customerID": "customer_id",
    "tenure": "subscription_months",
    "MonthlyCharges": "monthly_mrr",
    "TotalCharges": "lifetime_value",
    "Contract": "plan_type",
    "Churn": "churned",
}

# Source CSV header of the experiment file, and the load-time column names.
AB_CSV_HEADER = ["user_id", "timestamp", "group", "landing_page", "converted"]
AB_RENAMES = {"timestamp": "ts", "group": "grp"}

# Plan dimension: (plan_type, plan_order, plan_label).
PLAN_DIMENSION = [
    ("Month-to-month", 1, "Starter"),
    ("One year", 2, "Growth"),
    ("Two year", 3, "Enterprise"),
]
PLAN_DIMENSION_SCHEMA = T.StructType([
    T.StructField("plan_type", T.StringType(), False),
    T.StructField("plan_order", T.LongType(), False),
    T.StructField("plan_label", T.StringType(), False),
])

# Data dictionary: (Field, Definition, Type, Notes).
DATA_DICTIONARY = [
    ("customer_id", "Unique customer identifier", "Column", "Primary key, not aggregated"),
    ("plan_type", "Subscription contract type: Month-to-month / One year / Two year", "Column",
     "Raw value; display labels applied via dim_plan_type"),
    ("subscription_months", "Duration of subscription in months at time of data export", "Column",
     "Basis for Lifecycle Stage and At-Risk flag"),
    ("monthly_mrr", "Monthly Recurring Revenue for this customer (USD)", "Column",
     "Summed in Total MRR and At-Risk MRR"),
    ("lifetime_value", "Total revenue over full subscription history (USD)", "Column",
     "Pre-calculated in source; averaged in Avg LTV"),
    ("churned", "Cancellation status: Yes = churned, No = active", "Column",
     "Used as filter in 4 of 6 measures"),
    ("payment_method", "Billing method: Bank transfer / Credit card / Electronic check / Mailed check",
     "Column", "Churn rate varies significantly by method"),
    ("Lifecycle Stage", "New (0-6mo) / Growing (6-24mo) / Mature (24mo+) based on subscription_months",
     "Calculated Column", "Row-level label; must be a column, not a measure"),
    ("Total MRR", "Sum of monthly_mrr for active subscribers only", "Measure",
     'CALCULATE with churned = "No" filter'),
    ("Churn Rate %", "Churned customers divided by all customers", "Measure",
     "No churn filter — includes all rows"),
    ("Avg LTV", "Average lifetime value across all customers", "Measure", "Includes churned — intentional"),
    ("Avg Tenure Months", "Average subscription duration, active customers only", "Measure",
     'CALCULATE with churned = "No" filter'),
    ("At-Risk MRR", "MRR from active customers with under 6 months tenure", "Measure",
     "Two filter conditions applied"),
    ("LTV MRR Ratio", "Avg LTV divided by Avg MRR", "Measure", 'Fix format string to 0.0"x"'),
]
DATA_DICTIONARY_SCHEMA = T.StructType([
    T.StructField("Field", T.StringType()),
    T.StructField("Definition", T.StringType()),
    T.StructField("Type", T.StringType()),
    T.StructField("Notes", T.StringType()),
])

# Expected source row counts of the original files (download gate).
EXPECTED_SOURCE_ROWS = {"customers": 7043, "ab_test": 294478}

# Column that a reader adds on demand: the place of a row in its source files, as a sortable struct.
FILE_ORDER = "file_order"
