"""factgrid: claim verification and corpus preparation as Spark DataFrame operators."""
