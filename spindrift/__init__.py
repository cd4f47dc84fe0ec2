"""spindrift: temporal selection and corpus analytics as Spark DataFrame plans."""
