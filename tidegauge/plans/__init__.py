"""End-to-end flows built from the operators: training, prediction, model store."""
