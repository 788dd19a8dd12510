"""authsift: authentication-alert analytics on Spark.

sshd logs and Windows logon events -> typed events -> one alert per source ->
geo / reputation enrichment -> rule triage -> ranked queue, plus analyst tables,
evaluation against labels, case state, model I/O tables and streaming variants.
Every step is a DataFrame function; see README.md and INVENTORY.md.
"""

__version__ = "0.1.0"
