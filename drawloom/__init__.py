"""Set-draw analytics on Spark: reconcile, audit, feature, model, issue and score dated set-valued events."""
