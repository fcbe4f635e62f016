"""End-to-end plans composed from the operators: dataset build, sweep, report."""
