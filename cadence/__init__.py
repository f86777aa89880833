"""cadence: a Spark-native engine for multi-user listening-session analytics.

Every operator is a ``DataFrame -> DataFrame`` function keyed by ``session_id``
(or by user / item where the reference works population-wide), free of actions,
so one Spark job serves all sessions at once and Catalyst does the planning.
"""

__version__ = "0.1.0"
