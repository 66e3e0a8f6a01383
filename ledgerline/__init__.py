"""ledgerline: event-log analytics and training-data operators on Spark DataFrames."""
