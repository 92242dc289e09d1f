"""Payment reporting and settlement reconciliation as Spark DataFrame jobs."""
