"""siteweave: web-to-CRM enrichment as PySpark DataFrame operators."""
