"""Document analytics on Spark: cleaning, segmentation, entities, projections, frequencies, spans."""
