"""ledgerlark: document analytics and cited retrieval as composable Spark DataFrame operators."""
