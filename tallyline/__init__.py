"""Per-entity event statistics, line pricing and wager backtests on Spark DataFrames."""
