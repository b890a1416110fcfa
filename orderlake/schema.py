"""The order-line model: column names, schemas and the stored layout."""

from __future__ import annotations

from pyspark.sql import types as T

# The 22 public columns in their published order.
ORDER_LINE_COLUMNS = [
    "Order_Number", "Date", "Customer_Name", "Email", "Ship_Date",
    "Shipping_Address_Line1", "Shipping_Address_Line2", "Shipping_City",
    "Shipping_State", "Shipping_Zip", "Product_Code", "Product_Description",
    "Unit_Price", "Quantity", "Extended_Price", "Service_Fee",
    "Total_Discount", "Sub_Total", "Shipping", "Total_Amount",
    "Source_File", "Source_Page",
]

# A model response holds everything but the two provenance columns.
EXTRACTED_COLUMNS = ORDER_LINE_COLUMNS[:20]

# The fields a verification response may correct.
VERIFIED_COLUMNS = [
    "Customer_Name", "Email", "Shipping_Address_Line1", "Shipping_Address_Line2",
    "Shipping_City", "Shipping_State", "Shipping_Zip",
]

# Fields a text search looks at, in document order.
SEARCH_COLUMNS = [
    "Order_Number", "Customer_Name", "Email", "Shipping_Address_Line1",
    "Shipping_City", "Shipping_State", "Shipping_Zip", "Product_Code",
    "Product_Description",
]

# The columns shown when browsing.
BROWSE_COLUMNS = [
    "Order_Number", "Date", "Customer_Name", "Shipping_City", "Shipping_State",
    "Product_Code", "Product_Description", "Quantity", "Total_Amount",
]

# Amounts that are typed on load; the other fees stay text.
MONEY_COLUMNS = ["Unit_Price", "Extended_Price", "Total_Amount", "Sub_Total"]

# Total ingest order. "First line of an order" and "store order" mean this key.
INGEST_KEY = "Ingest_Key"

MONEY = T.DecimalType(18, 4)

EXTRACTED_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in EXTRACTED_COLUMNS])
VERIFIED_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in VERIFIED_COLUMNS])

PAGE_SCHEMA = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("page_index", T.IntegerType()),
    T.StructField("text", T.StringType()),
    T.StructField("content", T.BinaryType()),
])

STORED_TO_DISPLAY = {
    **{c.lower(): c for c in ORDER_LINE_COLUMNS},
    "created_at": "Created_At",
    "updated_at": "Updated_At",
}
DISPLAY_TO_STORED = {display: stored for stored, display in STORED_TO_DISPLAY.items()}
