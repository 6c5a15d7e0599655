"""Analytics over captured web pages, as Spark DataFrame operators."""
