"""Mining software-change history and predicting defect-prone changes with Spark."""
