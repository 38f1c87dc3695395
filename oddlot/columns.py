"""Names of the canonical transaction columns."""

ID = "PaymentTransactionId"
RAW_TIME = "RequestInsertTime"
TIME = "Created_Time"
DAY_TEXT = "Created_Time_str"
HOUR = "hour"
MERCHANT = "merchant_id"
CUSTOMER = "customer_id"
PAIR_TEXT = "customer_merchant_id"
AMOUNT = "Amount"

PAIR = (CUSTOMER, MERCHANT)
BASE_COLUMNS = (ID, RAW_TIME, MERCHANT, CUSTOMER, AMOUNT)
