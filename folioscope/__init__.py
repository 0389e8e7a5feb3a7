"""folioscope: document retrieval and analytics expressed as Spark DataFrame jobs."""
